"""Queries of the imaging engine over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkplan.functions import scalar, segments
from inkplan.operators import bitmaps, components, pixels
from inkplan.operators import symbols as sym
from inkplan.plans import document
from inkplan.plans import fixtures as fx
from inkplan.plans.options import LAYOUTS, Encoding

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_W = fx.WIDTH
_INK = f"g < {fx.INK}"


def query(name: str, sql: str | None = None, *using: str):
    """Registers a query; using: the fixtures that its SQL builds on."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {', '.join(fx.SQL[u] for u in using)}{',' if using and sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if using else sql
        return function

    return add


# --- projections --------------------------------------------------------------------------------------------------


@query("gray_luma", "SELECT vec_id, x, CAST((19595 * r + 38470 * gr + 7471 * b + 32768) >> 16 AS BIGINT) AS g FROM rgba", "rgba")
def gray_luma(spark, sf_dir):
    return pixels.gray_of(fx.rgba(spark, sf_dir), "Rgb24").select("vec_id", "x", "g")


@query("gray_green", "SELECT vec_id, x, CAST(gr AS BIGINT) AS g FROM rgba", "rgba")
def gray_green(spark, sf_dir):
    return pixels.gray_of(fx.rgba(spark, sf_dir), "Bgr24", "green").select("vec_id", "x", "g")


@query("alpha_over_white", "+ l AS (SELECT vec_id, x, a, (19595 * r + 38470 * gr + 7471 * b + 32768) >> 16 AS g FROM rgba) SELECT vec_id, x, CAST(CASE WHEN a = 255 THEN g ELSE (g * a + 255 * (255 - a) + 127) // 255 END AS BIGINT) AS g FROM l", "rgba")
def alpha_over_white(spark, sf_dir):
    return pixels.gray_of(fx.rgba(spark, sf_dir), "Rgba32").select("vec_id", "x", "g")


@query("bytes_per_pixel", "SELECT * FROM (VALUES ('Gray8', 1), ('GrayAlpha16', 2), ('Rgb24', 3), ('Bgr24', 3), ('Rgba32', 4), ('Bgra32', 4)) t(layout, bytes)")
def bytes_per_pixel(spark, sf_dir):
    names = F.explode(F.array(*map(F.lit, LAYOUTS)))
    return spark.range(1).select(names.alias("layout")).withColumn("bytes", scalar.bytes_per_pixel(F.col("layout")))


@query("effective_threshold", "SELECT mode, t AS threshold, CAST(CASE WHEN t >= 0 THEN t WHEN mode = 'global' THEN 128 ELSE 200 END AS BIGINT) AS effective FROM (SELECT unnest(['global', 'adaptive']) AS mode), (SELECT unnest(range(-3, 256)) AS t)")
def effective_threshold(spark, sf_dir):
    rows = spark.range(-3, 256).select(F.explode(F.array(F.lit("global"), F.lit("adaptive"))).alias("mode"), F.col("id").alias("threshold"))
    return rows.withColumn("effective", scalar.effective_threshold(F.col("mode"), F.col("threshold")).cast("long"))


@query("gamma_lut", "SELECT i AS level, CAST(CASE WHEN i < 90 THEN 0 WHEN i > 190 THEN 255 ELSE least(255, floor(255.0::DOUBLE * CAST(CAST(i - 90 AS FLOAT) / CAST(100 AS FLOAT) AS DOUBLE) + 0.5::DOUBLE)) END AS BIGINT) AS out FROM (SELECT unnest(range(0, 256)) AS i)")
def gamma_lut(spark, sf_dir):
    return spark.range(256).select(F.col("id").alias("level"), scalar.gamma_level("id", 1.0, 90, 190).alias("out"))


@query("threshold_global", "SELECT doc_id, y, CAST(sum((g < 128)::INT) AS BIGINT) AS black, CAST(count(*) AS BIGINT) AS n FROM px GROUP BY doc_id, y", "codes", "px")
def threshold_global(spark, sf_dir):
    return pixels.threshold(fx.doc_pixels(spark, sf_dir), 128).groupBy("doc_id", "y").agg(F.sum("ink").alias("black"), F.count("*").alias("n"))


def _upsample_sql(f: int) -> str:
    return f"""+ s AS (SELECT page_no, x, y, g, coalesce(lead(g) OVER (PARTITION BY page_no, y ORDER BY x), g) AS b FROM emb),
w AS (SELECT page_no, x * {f} + k AS x, y, ((({f} - k) * g + k * b) * 256) // {f} AS v FROM s, (SELECT unnest(range(0, {f})) AS k)),
u AS (SELECT page_no, x, y, v, coalesce(lead(v) OVER (PARTITION BY page_no, x ORDER BY y), v) AS n FROM w),
o AS (SELECT page_no, x, y * {f} + k AS y, (({f} - k) * v + k * n) // {f} AS v FROM u, (SELECT unnest(range(0, {f})) AS k))
SELECT page_no, y, CAST(sum(v) AS BIGINT) AS total, CAST(sum((v < 128 * 256)::INT) AS BIGINT) AS black, CAST(sum(CASE WHEN v < 128 * 256 THEN x ELSE 0 END) AS BIGINT) AS places FROM o GROUP BY page_no, y"""


def _upsampled(factor: int) -> Query:
    def run(spark, sf_dir):
        v, black = F.col("v"), F.col("v") < 128 * 256
        return pixels.upsampled(fx.emb_pages(spark, sf_dir), factor).groupBy("page_no", "y").agg(F.sum(v).alias("total"), F.sum(black.cast("long")).alias("black"), F.sum(F.when(black, F.col("x")).otherwise(0)).alias("places"))

    return run


for _f in (2, 4):
    query(f"upsample{_f}", _upsample_sql(_f), "emb")(_upsampled(_f))


# --- background ---------------------------------------------------------------------------------------------------

_DIL = "h AS (SELECT page_no, x, y, g, max((g < 60)::INT) OVER (PARTITION BY page_no, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM emb), d AS (SELECT page_no, x, y, g, max(m) OVER (PARTITION BY page_no, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near_ink FROM h)"
_TILES = f"{_DIL}, t AS (SELECT page_no, x // 10 AS tx, y // 15 AS ty, CASE WHEN count(*) = 150 AND sum(1 - near_ink) >= 40 THEN CAST(sum(CASE WHEN near_ink = 0 THEN g ELSE 0 END) AS BIGINT) // CAST(sum(1 - near_ink) AS BIGINT) END AS level FROM d GROUP BY page_no, x // 10, y // 15)"
_FILL = f"""{_TILES}, c AS (SELECT page_no, tx, ty, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY page_no, tx ORDER BY ty ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(level IGNORE NULLS) OVER (PARTITION BY page_no, tx ORDER BY ty ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM t),
f AS (SELECT page_no, tx, ty, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY page_no, ty ORDER BY tx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(level IGNORE NULLS) OVER (PARTITION BY page_no, ty ORDER BY tx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM c)"""
_INV = f"""{_FILL}, b AS (SELECT page_no, tx, ty, sum(level) OVER v AS s, count(*) OVER v AS n FROM f WHERE level IS NOT NULL WINDOW v AS (PARTITION BY page_no, ty ORDER BY tx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
bb AS (SELECT page_no, tx, ty, CAST(sum(s) OVER v AS BIGINT) AS s, CAST(sum(n) OVER v AS BIGINT) AS n FROM b WINDOW v AS (PARTITION BY page_no, tx ORDER BY ty ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
i AS (SELECT page_no, tx, ty, CAST(CASE WHEN (s + n // 2) // n > 0 THEN 51200 // ((s + n // 2) // n) ELSE 100 END AS BIGINT) AS factor FROM bb)"""
_APPLY = f"""{_INV}, z AS (SELECT page_no FROM emb GROUP BY page_no HAVING max(x) + 1 > 40 AND max(y) + 1 > 60),
a AS (SELECT e.page_no, e.x, e.y, CAST(CASE WHEN factor IS NULL THEN g ELSE least(255, (g * factor) >> 8) END AS BIGINT) AS g FROM emb e LEFT JOIN (SELECT * FROM i WHERE page_no IN (SELECT page_no FROM z)) i ON i.page_no = e.page_no AND i.tx = e.x // 10 AND i.ty = e.y // 15)"""
_CLEAN = f"{_APPLY}, k AS (SELECT page_no, x, y, CAST(CASE WHEN g < 90 THEN 0 WHEN g > 190 THEN 255 ELSE least(255, floor(255.0::DOUBLE * CAST(CAST(g - 90 AS FLOAT) / CAST(100 AS FLOAT) AS DOUBLE) + 0.5::DOUBLE)) END AS BIGINT) AS g FROM a)"


@query("fg_dilate", f"+ {_DIL} SELECT page_no, x, y, CAST(near_ink AS BIGINT) AS near_ink FROM d", "emb")
def fg_dilate(spark, sf_dir):
    return pixels.dilated(fx.emb_pages(spark, sf_dir)).select("page_no", "x", "y", "near_ink")


@query("bg_tiles", f"+ {_TILES} SELECT page_no, tx, ty, CAST(level AS BIGINT) AS level FROM t", "emb")
def bg_tiles(spark, sf_dir):
    return pixels.background_tiles(fx.emb_pages(spark, sf_dir))


@query("bg_fill", f"+ {_FILL} SELECT page_no, tx, ty, CAST(level AS BIGINT) AS level FROM f", "emb")
def bg_fill(spark, sf_dir):
    return pixels.filled_tiles(pixels.background_tiles(fx.emb_pages(spark, sf_dir)))


@query("bg_inverse", f"+ {_INV} SELECT page_no, tx, ty, factor FROM i", "emb")
def bg_inverse(spark, sf_dir):
    return pixels.inverse_tiles(pixels.filled_tiles(pixels.background_tiles(fx.emb_pages(spark, sf_dir))).where("level is not null"))


@query("bg_apply", f"+ {_APPLY} SELECT page_no, x, y, g FROM a", "emb")
def bg_apply(spark, sf_dir):
    return pixels.background_applied(fx.emb_pages(spark, sf_dir)).select("page_no", "x", "y", "g")


@query("clean_to_white", f"+ {_CLEAN} SELECT page_no, x, y, g FROM k", "emb")
def clean_to_white(spark, sf_dir):
    return pixels.cleaned(fx.emb_pages(spark, sf_dir)).select("page_no", "x", "y", "g")


@query("binarize_adaptive", f"+ {_CLEAN} SELECT page_no, y, CAST(sum((g < 200)::INT) AS BIGINT) AS black, CAST(sum(CASE WHEN g < 200 THEN x * x ELSE 0 END) AS BIGINT) AS places FROM k GROUP BY page_no, y", "emb")
def binarize_adaptive(spark, sf_dir):
    ink = pixels.threshold(pixels.cleaned(fx.emb_pages(spark, sf_dir)), 200)
    return ink.groupBy("page_no", "y").agg(F.sum("ink").alias("black"), F.sum(F.col("ink") * F.col("x") * F.col("x")).alias("places"))


# --- bitmaps ------------------------------------------------------------------------------------------------------

_WORDS = f"rw AS (SELECT doc_id, y, CAST(sum(CASE WHEN x < 32 AND {_INK} THEN 1::BIGINT << (31 - x) ELSE 0 END) AS BIGINT) AS w0, CAST(sum(CASE WHEN x >= 32 AND {_INK} THEN 1::BIGINT << (63 - x) ELSE 0 END) AS BIGINT) AS w1 FROM px GROUP BY doc_id, y)"


def _two(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("doc_id", *more, "y", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


@query("pack_words", f"+ {_WORDS} SELECT * FROM rw", "codes", "px")
def pack_words(spark, sf_dir):
    return _two(fx.doc_rows(spark, sf_dir))


@query("packed_bytes", f"+ {_WORDS} SELECT doc_id, y, upper(printf('%08x', w0) || printf('%08x', w1)) AS data, upper(printf('%08x', 4294967295 - w0) || printf('%08x', 4294967295 - w1)) AS inverted FROM rw", "codes", "px")
def packed_bytes(spark, sf_dir):
    rows = bitmaps.to_packed(fx.doc_rows(spark, sf_dir), _W)
    return bitmaps.to_packed(rows.withColumnRenamed("data", "d"), _W, False).select("doc_id", "y", F.hex("d").alias("data"), F.hex("data").alias("inverted"))


@query("import_packed", f"+ {_WORDS} SELECT doc_id, y, w0, w1 & 4294963200 AS w1 FROM rw", "codes", "px")
def import_packed(spark, sf_dir):
    rows = bitmaps.to_packed(fx.doc_rows(spark, sf_dir), _W).drop("words")
    return _two(bitmaps.from_packed(rows, _W - 12))


@query("unpack_words", f"SELECT doc_id, y, x, CAST(({_INK})::INT AS BIGINT) AS bit FROM px", "codes", "px")
def unpack_words(spark, sf_dir):
    return fx.doc_rows(spark, sf_dir).select("doc_id", "y", F.posexplode(scalar.unpacked(F.col("words"), F.lit(_W))).alias("x", "bit")).select("doc_id", "y", F.col("x").cast("long").alias("x"), "bit")


@query("popcount", f"SELECT doc_id, CAST(sum(({_INK})::INT) AS BIGINT) AS black FROM px GROUP BY doc_id", "codes", "px")
def popcount(spark, sf_dir):
    return bitmaps.ink(fx.doc_rows(spark, sf_dir), ["doc_id"]).select("doc_id", "black")


@query("blank_pages", f"SELECT doc_id, sum((g < {fx.BLANK})::INT) = 0 AS blank FROM px GROUP BY doc_id", "codes", "px")
def blank_pages(spark, sf_dir):
    return bitmaps.ink(fx.doc_rows(spark, sf_dir, fx.BLANK), ["doc_id"]).select("doc_id", "blank")


@query("bitmaps_equal", f"SELECT doc_id, bool_and(({_INK}) = (g < 120)) AS same FROM px GROUP BY doc_id", "codes", "px")
def bitmaps_equal(spark, sf_dir):
    return bitmaps.equal(fx.doc_rows(spark, sf_dir), fx.doc_rows(spark, sf_dir, 120), ["doc_id"])


_ROP_SQL = {"xor": "(a.k <> b.k)", "or": "(a.k OR b.k)", "and": "(a.k AND b.k)", "andnot": "(a.k AND NOT b.k)", "copy": "b.k"}


def _rop(operation: str) -> None:
    sql = f"""+ k AS (SELECT doc_id, x, y, {_INK} AS k FROM px),
o AS (SELECT a.doc_id, a.x, a.y, CASE WHEN b.k IS NULL THEN a.k ELSE {_ROP_SQL[operation]} END AS k FROM k a LEFT JOIN k b ON b.doc_id = a.doc_id AND b.x = a.x - 5 AND b.y = a.y - 2)
SELECT doc_id, y, CAST(sum(CASE WHEN x < 32 AND k THEN 1::BIGINT << (31 - x) ELSE 0 END) AS BIGINT) AS w0, CAST(sum(CASE WHEN x >= 32 AND k THEN 1::BIGINT << (63 - x) ELSE 0 END) AS BIGINT) AS w1 FROM o GROUP BY doc_id, y"""

    def run(spark, sf_dir):
        rows = fx.doc_rows(spark, sf_dir)
        return _two(bitmaps.combine(rows, rows, operation, 5, 2, ["doc_id"], _W))

    query(f"rop_{operation}", sql, "codes", "px")(run)


for _o in _ROP_SQL:
    _rop(_o)


@query("clip", f"SELECT doc_id, y - 1 AS y, CAST(sum(CASE WHEN x >= 7 AND x < 39 AND {_INK} THEN 1::BIGINT << (38 - x) ELSE 0 END) AS BIGINT) AS w0, CAST(sum(CASE WHEN x >= 39 AND x < 47 AND {_INK} THEN 1::BIGINT << (70 - x) ELSE 0 END) AS BIGINT) AS w1 FROM px WHERE y >= 1 AND y < 21 GROUP BY doc_id, y", "codes", "px")
def clip(spark, sf_dir):
    return _two(bitmaps.clip(fx.doc_rows(spark, sf_dir), 7, 1, 40, 20, _W))


@query("border", f"+ {_WORDS} SELECT doc_id, y + 6 AS y, w0 >> 6 AS w0, ((w0 & 63) << 26) | (w1 >> 6) AS w1, (w1 & 63) << 26 AS w2 FROM rw", "codes", "px")
def border(spark, sf_dir):
    rows = bitmaps.bordered(fx.doc_rows(spark, sf_dir), 6, _W)
    return rows.select("doc_id", "y", *(F.col("words")[i].alias(f"w{i}") for i in range(3)))


@query("border_full", f"""+ {_WORDS}, hh AS (SELECT doc_id, max(y) + 1 AS h FROM rw GROUP BY doc_id) SELECT doc_id, y + 6 AS y, w0 >> 6 AS w0, ((w0 & 63) << 26) | (w1 >> 6) AS w1, (w1 & 63) << 26 AS w2 FROM rw
UNION ALL SELECT doc_id, CASE WHEN k < 6 THEN k ELSE h + k END AS y, 0 AS w0, 0 AS w1, 0 AS w2 FROM hh, (SELECT unnest(range(0, 12)) AS k)""", "codes", "px")
def border_full(spark, sf_dir):
    rows = bitmaps.bordered(fx.doc_rows(spark, sf_dir), 6, _W, ["doc_id"])
    return rows.select("doc_id", "y", *(F.col("words")[i].alias(f"w{i}") for i in range(3)))


@query("border_removed", f"+ {_WORDS} SELECT doc_id, y, w0, w1 FROM rw", "codes", "px")
def border_removed(spark, sf_dir):
    return _two(bitmaps.unbordered(bitmaps.bordered(fx.doc_rows(spark, sf_dir), 6, _W, ["doc_id"]), 6, _W + 12))


@query("clip_white", f"""+ ys AS (SELECT doc_id, y FROM codes, (SELECT unnest(range(0, 20)) AS y)), ik AS (SELECT doc_id, x + 5 AS x, y + 2 AS y FROM px WHERE {_INK} AND x < 35)
SELECT ys.doc_id, ys.y, CAST(coalesce(sum(CASE WHEN x < 32 THEN 1::BIGINT << (31 - x) END), 0) AS BIGINT) AS w0, CAST(coalesce(sum(CASE WHEN x >= 32 THEN 1::BIGINT << (63 - x) END), 0) AS BIGINT) AS w1 FROM ys LEFT JOIN ik ON ik.doc_id = ys.doc_id AND ik.y = ys.y GROUP BY ys.doc_id, ys.y""", "codes", "px")
def clip_white(spark, sf_dir):
    return _two(bitmaps.clip(fx.doc_rows(spark, sf_dir), -5, -2, 40, 20, _W, ["doc_id"]))


@query("pixel_set", f"+ {_WORDS} SELECT doc_id, y, CASE WHEN y % 70 < 32 THEN w0 | (1::BIGINT << (31 - y % 70)) ELSE w0 END AS w0, CASE WHEN y % 70 BETWEEN 32 AND 63 THEN w1 & ~(1::BIGINT << (63 - y % 70)) ELSE w1 END AS w1 FROM rw", "codes", "px")
def pixel_set(spark, sf_dir):
    """Sets a pixel of the first word, clears one of the second, or changes nothing where the place is outside."""
    at = F.col("y") % 70
    return _two(fx.doc_rows(spark, sf_dir).withColumn("words", scalar.with_pixel(F.col("words"), at, at < 32)))


_RUNS = "rn AS (SELECT doc_id, y, min(x) AS l, max(x) AS r FROM (SELECT doc_id, x, y, x - row_number() OVER (PARTITION BY doc_id, y ORDER BY x) AS i FROM px WHERE {ink}) GROUP BY doc_id, y, i)"


@query("runs", f"+ {_RUNS.format(ink=_INK)} SELECT * FROM rn", "codes", "px")
def runs(spark, sf_dir):
    return bitmaps.runs_of_rows(fx.doc_rows(spark, sf_dir), _W, ["doc_id"])


@query("runs_from_pixels", f"+ {_RUNS.format(ink=_INK)} SELECT * FROM rn", "codes", "px")
def runs_from_pixels(spark, sf_dir):
    return bitmaps.runs(fx.doc_pixels(spark, sf_dir).where(F.col("g") < fx.INK), ["doc_id"])


_COMP = f"""{_RUNS.format(ink=f"g < {fx.BLANK}")}, rid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, l) AS id FROM rn),
e AS (SELECT a.doc_id, a.id AS a, b.id AS b FROM rid a JOIN rid b ON a.doc_id = b.doc_id AND b.y = a.y + 1 AND b.l <= a.r + {{reach}} AND b.r >= a.l - {{reach}}),
ee AS (SELECT doc_id, a, b FROM e UNION ALL SELECT doc_id, b, a FROM e),
lab AS (SELECT doc_id, id, id AS root FROM rid UNION SELECT ee.doc_id, ee.b, lab.root FROM lab JOIN ee ON ee.doc_id = lab.doc_id AND ee.a = lab.id WHERE lab.root < ee.b),
own AS (SELECT doc_id, id, min(root) AS root FROM lab GROUP BY doc_id, id)"""


@query("component_bbox", f"+ {_COMP.format(reach=1)} SELECT own.doc_id, dense_rank() OVER (PARTITION BY own.doc_id ORDER BY own.root) - 1 AS comp_no, min(l) AS x, min(y) AS y, max(r) - min(l) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(sum(r - l + 1) AS BIGINT) AS area FROM own JOIN rid ON rid.doc_id = own.doc_id AND rid.id = own.id GROUP BY own.doc_id, own.root", "codes", "px")
def component_bbox(spark, sf_dir):
    return components.components(fx.doc_pages(spark, sf_dir, fx.BLANK), packed=False).select("doc_id", "comp_no", "x", "y", "w", "h", "area")


for _name, _reach in (("four", 0), ("eight", 1)):

    def _count(spark, sf_dir, name=_name):
        found = components.component_counts(fx.doc_pages(spark, sf_dir, fx.BLANK))
        return found.select("doc_id", F.col(name).alias("components"))

    query(f"component_count_{_name}", f"+ {_COMP.format(reach=_reach)} SELECT codes.doc_id, count(DISTINCT root) AS components FROM codes LEFT JOIN own ON own.doc_id = codes.doc_id GROUP BY codes.doc_id", "codes", "px")(_count)


@query("centroids", f"+ {_COMP.format(reach=1)}, pxs AS (SELECT own.doc_id, own.root, y, unnest(range(l, r + 1)) AS x FROM own JOIN rid ON rid.doc_id = own.doc_id AND rid.id = own.id), o AS (SELECT doc_id, root, min(x) AS x0, min(y) AS y0, count(*) AS area, sum(x) AS sx, sum(y) AS sy FROM pxs GROUP BY doc_id, root) SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY root) - 1 AS comp_no, area, CAST(CAST(sx + area * (6 - x0) AS FLOAT) / CAST(area AS FLOAT) AS FLOAT) AS cx, CAST(CAST(sy + area * (6 - y0) AS FLOAT) / CAST(area AS FLOAT) AS FLOAT) AS cy FROM o", "codes", "px")
def centroids(spark, sf_dir):
    return components.components(fx.doc_pages(spark, sf_dir, fx.BLANK), packed=False).select("doc_id", "comp_no", "area", "cx", "cy")


@query("down_counts", f"SELECT doc_id, y, CAST(sum(({_INK})::INT) AS BIGINT) AS n, CAST(coalesce(sum(sum(({_INK})::INT)) OVER (PARTITION BY doc_id ORDER BY y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM px GROUP BY doc_id, y", "codes", "px")
def down_counts(spark, sf_dir):
    return components.down_counts(fx.doc_rows(spark, sf_dir).select("doc_id", "y", scalar.black_count(F.col("words")).alias("n")), ["doc_id"])


_LTP = f"{_WORDS}, lt AS (SELECT doc_id, y, CASE WHEN w0 = lag(w0) OVER v AND w1 = lag(w1) OVER v THEN 1 ELSE 0 END AS ltp FROM rw WINDOW v AS (PARTITION BY doc_id ORDER BY y))"


@query("tpgd_flags", f"+ {_LTP} SELECT doc_id, y, CAST(ltp AS BIGINT) AS ltp, CAST(xor(ltp, coalesce(lag(ltp) OVER (PARTITION BY doc_id ORDER BY y), 0)) AS BIGINT) AS sltp FROM lt", "codes", "px")
def tpgd_flags(spark, sf_dir):
    return bitmaps.typical_rows(fx.doc_rows(spark, sf_dir), ["doc_id"]).select("doc_id", "y", "ltp", "sltp")


def _context_sql() -> str:
    near = [(dx, 2) for dx in range(-2, 3)] + [(dx, 1) for dx in range(-3, 4)] + [(dx, 0) for dx in range(-4, 0)]
    terms = []
    for i, (dx, dy) in enumerate(near):
        name = f"r{dy}"
        terms.append(f"(CASE WHEN x + ({dx}) BETWEEN 0 AND 63 THEN coalesce(({name}[x + ({dx}) + 1])::BIGINT, 0) ELSE 0 END) * {1 << (15 - i)}")
    return f"""+ li AS (SELECT doc_id, y, list(({_INK})::INT ORDER BY x) AS r0 FROM px GROUP BY doc_id, y),
lj AS (SELECT doc_id, y, r0, lag(r0, 1) OVER v AS r1, lag(r0, 2) OVER v AS r2 FROM li WINDOW v AS (PARTITION BY doc_id ORDER BY y)),
lx AS (SELECT *, unnest(range(0, 64)) AS x FROM lj)
SELECT CAST({' + '.join(terms)} AS BIGINT) AS context, CAST(r0[x + 1] AS BIGINT) AS bit, CAST(count(*) AS BIGINT) AS n FROM lx GROUP BY 1, 2"""


@query("generic_context_hist", _context_sql(), "codes", "px")
def generic_context_hist(spark, sf_dir):
    return bitmaps.context_counts(fx.doc_rows(spark, sf_dir), _W, ["doc_id"])


# --- symbols ------------------------------------------------------------------------------------------------------

_LL = "gl AS (SELECT *, ul_x AS ll_x, ul_y + h - 1 AS ll_y FROM glyphs)"
_USES = "us AS (SELECT doc_id, class_no, count(*) AS uses FROM glyphs GROUP BY doc_id, class_no), pg AS (SELECT doc_id, max(page_no) = min(page_no) AS single FROM glyphs GROUP BY doc_id), sh AS (SELECT us.doc_id, class_no, uses FROM us JOIN pg ON pg.doc_id = us.doc_id WHERE uses > 1 OR single)"
_DICT = f"{_USES}, se AS (SELECT DISTINCT g.doc_id, g.class_no, w, h, g.class_no AS ord FROM glyphs g JOIN sh ON sh.doc_id = g.doc_id AND sh.class_no = g.class_no), di AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h, w, ord) - 1 AS id FROM se)"


def _dictionary(spark, sf_dir) -> DataFrame:
    own = fx.glyphs(spark, sf_dir)
    chosen = sym.shared(own, ["doc_id"]).select("doc_id", "class_no")
    return sym.dictionary(own.select("doc_id", "class_no", "w", "h").distinct().join(chosen, ["doc_id", "class_no"]).withColumn("ord", F.col("class_no")), ["doc_id"])


@query("symbol_uses", f"+ {_USES} SELECT * FROM us", "glyphs")
def symbol_uses(spark, sf_dir):
    return sym.uses(fx.glyphs(spark, sf_dir), ["doc_id"])


@query("shared_symbols", f"+ {_USES} SELECT * FROM sh", "glyphs")
def shared_symbols(spark, sf_dir):
    return sym.shared(fx.glyphs(spark, sf_dir), ["doc_id"])


@query("page_symbols", f"+ {_USES} SELECT g.doc_id, g.page_no, g.class_no, row_number() OVER (PARTITION BY g.doc_id, g.page_no ORDER BY comp_no) - 1 AS ord FROM glyphs g LEFT JOIN sh ON sh.doc_id = g.doc_id AND sh.class_no = g.class_no WHERE sh.doc_id IS NULL", "glyphs")
def page_symbols(spark, sf_dir):
    return sym.page_only(fx.glyphs(spark, sf_dir), ["doc_id"])


@query("dict_order", f"+ {_DICT} SELECT doc_id, class_no, id FROM di", "glyphs")
def dict_order(spark, sf_dir):
    return _dictionary(spark, sf_dir).select("doc_id", "class_no", "id")


@query("dict_deltas", f"+ {_DICT} SELECT doc_id, id, h - coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY h, w, ord), 0) AS dh, w - coalesce(lag(w) OVER (PARTITION BY doc_id, h ORDER BY w, ord), 0) AS dw FROM di", "glyphs")
def dict_deltas(spark, sf_dir):
    return _dictionary(spark, sf_dir).select("doc_id", "id", "dh", "dw")


@query("text_order", f"+ {_LL} SELECT doc_id, page_no, comp_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY ll_y, ll_x, comp_no) - 1 AS place FROM gl", "glyphs")
def text_order(spark, sf_dir):
    return sym.text_order(sym.lower_left(fx.glyphs(spark, sf_dir)), ["doc_id", "page_no"]).select("doc_id", "page_no", "comp_no", "place")


@query("strip_deltas", f"""+ {_LL}, n1 AS (SELECT *, row_number() OVER v AS n, ll_x - (lag(ll_x) OVER v + lag(w) OVER v - 1) AS step FROM gl WINDOW v AS (PARTITION BY doc_id, page_no, ll_y ORDER BY ll_x, comp_no)),
hd AS (SELECT doc_id, page_no, ll_y, ll_y - coalesce(lag(ll_y) OVER v, 0) AS dt, ll_x - coalesce(lag(ll_x) OVER v, 0) AS fs FROM n1 WHERE n = 1 WINDOW v AS (PARTITION BY doc_id, page_no ORDER BY ll_y))
SELECT n1.doc_id, n1.page_no, comp_no, CASE WHEN n = 1 THEN hd.dt END AS dt, CASE WHEN n = 1 THEN hd.fs ELSE step END AS ds FROM n1 JOIN hd ON hd.doc_id = n1.doc_id AND hd.page_no = n1.page_no AND hd.ll_y = n1.ll_y""", "glyphs")
def strip_deltas(spark, sf_dir):
    return sym.strip_deltas(sym.lower_left(fx.glyphs(spark, sf_dir)), ["doc_id", "page_no"]).select("doc_id", "page_no", "comp_no", "dt", "ds")


@query("symbol_ids", f"""+ {_DICT}, lo AS (SELECT g.doc_id, g.page_no, g.class_no, w, h, row_number() OVER (PARTITION BY g.doc_id, g.page_no ORDER BY h, w, comp_no) - 1 AS id FROM glyphs g LEFT JOIN sh ON sh.doc_id = g.doc_id AND sh.class_no = g.class_no WHERE sh.doc_id IS NULL),
cn AS (SELECT doc_id, count(*) AS c FROM di GROUP BY doc_id)
SELECT g.doc_id, g.comp_no, coalesce(di.id, lo.id + coalesce(cn.c, 0)) AS id FROM glyphs g LEFT JOIN di ON di.doc_id = g.doc_id AND di.class_no = g.class_no LEFT JOIN lo ON lo.doc_id = g.doc_id AND lo.page_no = g.page_no AND lo.class_no = g.class_no LEFT JOIN cn ON cn.doc_id = g.doc_id""", "glyphs")
def symbol_ids(spark, sf_dir):
    own = fx.glyphs(spark, sf_dir)
    return own.join(sym.class_ids(own, ["doc_id"]), ["doc_id", "class_no"]).select("doc_id", "comp_no", "id")


@query("symbol_ids_of_tables", f"""+ {_DICT}, lo AS (SELECT g.doc_id, g.page_no, g.class_no, w, h, row_number() OVER (PARTITION BY g.doc_id, g.page_no ORDER BY h, w, comp_no) - 1 AS id FROM glyphs g LEFT JOIN sh ON sh.doc_id = g.doc_id AND sh.class_no = g.class_no WHERE sh.doc_id IS NULL),
cn AS (SELECT doc_id, count(*) AS c FROM di GROUP BY doc_id)
SELECT g.doc_id, g.class_no, g.page_no, min(coalesce(di.id, lo.id + coalesce(cn.c, 0))) AS id FROM glyphs g LEFT JOIN di ON di.doc_id = g.doc_id AND di.class_no = g.class_no LEFT JOIN lo ON lo.doc_id = g.doc_id AND lo.page_no = g.page_no AND lo.class_no = g.class_no LEFT JOIN cn ON cn.doc_id = g.doc_id GROUP BY ALL""", "glyphs")
def symbol_ids_of_tables(spark, sf_dir):
    """The ids of classes on pages, from dictionaries given as tables."""
    own = fx.glyphs(spark, sf_dir)
    local = sym.page_only(own, ["doc_id"]).join(own.select("doc_id", "class_no", "w", "h").distinct(), ["doc_id", "class_no"])
    local = sym.dictionary(local, ["doc_id", "page_no"]).select("doc_id", "page_no", "class_no", "id")
    used = own.select("doc_id", "page_no", "class_no").distinct()
    return sym.symbol_ids(used, _dictionary(spark, sf_dir).select("doc_id", "class_no", "id"), local, ["doc_id"]).select("doc_id", "class_no", "page_no", "id")


@query("size_candidates", """+ te AS (SELECT doc_id, class_no, min(w) AS w, min(h) AS h FROM glyphs GROUP BY doc_id, class_no)
SELECT a.doc_id, a.class_no, b.class_no AS template, b.w - a.w AS dx, b.h - a.h AS dy FROM te a JOIN te b ON a.doc_id = b.doc_id AND abs(a.w - b.w) <= 2 AND abs(a.h - b.h) <= 2""", "glyphs")
def size_candidates(spark, sf_dir):
    own = fx.glyphs(spark, sf_dir).groupBy("doc_id", "class_no").agg(F.min("w").alias("w"), F.min("h").alias("h"))
    found = sym.size_candidates(own.withColumns({"w0": F.col("w"), "h0": F.col("h")}), own.withColumnRenamed("class_no", "template"), ["doc_id"])
    return found.select("doc_id", "class_no", "template", (F.col("w") - F.col("w0")).alias("dx"), (F.col("h") - F.col("h0")).alias("dy"))


@query("weighted_threshold", "SELECT DISTINCT w, h, area, CAST(CAST(CAST(0.92 AS FLOAT) AS DOUBLE) + (1.0::DOUBLE - CAST(CAST(0.92 AS FLOAT) AS DOUBLE)) * CAST(CAST(0.5 AS FLOAT) AS DOUBLE) * area / (w * h) AS FLOAT) AS threshold FROM (SELECT w, h, unnest(range(1, w * h + 1)) AS area FROM (SELECT DISTINCT w, h FROM glyphs))", "glyphs")
def weighted_threshold(spark, sf_dir):
    boxes = fx.glyphs(spark, sf_dir).select("w", "h").distinct().withColumn("area", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w") * F.col("h"))))
    return boxes.withColumn("threshold", scalar.weighted_threshold(0.92, 0.5, F.col("area"), F.col("w") * F.col("h")))


@query("placement_shift", """+ ce AS (SELECT page_no, x, CAST(CAST(sum(g * y) AS FLOAT) / CAST(sum(g) AS FLOAT) AS FLOAT) AS c FROM emb GROUP BY page_no, x), df AS (SELECT a.page_no, a.x, CAST(a.c - b.c AS FLOAT) AS v FROM ce a JOIN ce b ON a.page_no = b.page_no AND b.x = (a.x + 1) % 64)
SELECT page_no, x, CAST(CASE WHEN v >= 0 THEN trunc(CAST(v + CAST(0.5 AS FLOAT) AS FLOAT)) ELSE trunc(CAST(v - CAST(0.5 AS FLOAT) AS FLOAT)) END AS INT) AS shift FROM df""", "emb")
def placement_shift(spark, sf_dir):
    center = fx.emb_pages(spark, sf_dir).groupBy("page_no", "x").agg((F.sum(F.col("g") * F.col("y")).cast("float") / F.sum("g").cast("float")).cast("float").alias("c"))
    other = center.select("page_no", ((F.col("x") + 63) % 64).alias("x"), F.col("c").alias("d"))
    return center.join(other, ["page_no", "x"]).select("page_no", "x", sym.shift_between("c", "d").alias("shift"))


_EV = "ev AS (SELECT event_id AS key, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), bits AS (SELECT event_id AS key, x, y FROM events, (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 8)) AS y) WHERE ((event_id * 2654435761::BIGINT + y * 40503::BIGINT + x * 2246822519::BIGINT) >> 7) & 1 = 1), ink AS (SELECT key, count(*) AS n FROM bits GROUP BY key)"


def _event_bitmaps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each event with the one before it of the same user, and the events' pages as rows of 32-bit words."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pairs = events.select(F.col("event_id").alias("a"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b")).where("b is not null")
    rows = events.select(F.col("event_id").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("y"))
    bit = lambda x: F.shiftright(F.col("key") * 2654435761 + F.col("y") * 40503 + x * 2246822519, 7).bitwiseAND(F.lit(1))
    return pairs, rows.withColumn("words", F.array(sum((bit(x) * (1 << (31 - x)) for x in range(8)), F.lit(0).cast("long"))))


@query("correlation_pairs", f"""+ {_EV}, o AS (SELECT ev.key AS a, ev.prev AS b, count(q.key) AS n FROM ev LEFT JOIN bits p ON p.key = ev.key LEFT JOIN bits q ON q.key = ev.prev AND q.x = p.x - 1 AND q.y = p.y WHERE ev.prev IS NOT NULL GROUP BY ev.key, ev.prev)
SELECT a, b, o.n AS both, i.n AS ink_a, j.n AS ink_b, o.n >= ceil(sqrt(CAST(CAST(0.4 AS FLOAT) AS DOUBLE) * i.n * j.n)) AS match FROM o JOIN ink i ON i.key = a JOIN ink j ON j.key = b""", "codes")
def correlation_pairs(spark, sf_dir):
    pairs, rows = _event_bitmaps(spark, sf_dir)
    return sym.correlated(pairs.withColumn("dx", F.lit(1)).withColumn("dy", F.lit(0)), rows, 0.4).select("a", "b", "both", "ink_a", "ink_b", "match")


_NEXT = f"ink AS (SELECT doc_id, x, y FROM px WHERE {_INK}), pr AS (SELECT doc_id AS a, lag(doc_id) OVER (ORDER BY doc_id) AS b FROM codes), tot AS (SELECT codes.doc_id, count(ink.x) AS n FROM codes LEFT JOIN ink ON ink.doc_id = codes.doc_id GROUP BY codes.doc_id)"


def _neighbours(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pages of 64 columns, each with the one before it. One row per page is sorted."""
    rows = fx.doc_rows(spark, sf_dir).withColumnRenamed("doc_id", "key")
    keys = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("key")).distinct()
    pairs = keys.select(F.col("key").alias("a"), F.lag("key").over(Window.orderBy("key")).alias("b")).where("b is not null")
    return pairs, rows


@query("correlation_wide", f"""+ {_NEXT}, o AS (SELECT pr.a, pr.b, count(q.x) AS n FROM pr LEFT JOIN ink p ON p.doc_id = pr.a LEFT JOIN ink q ON q.doc_id = pr.b AND q.x = p.x + 35 AND q.y = p.y - 2 WHERE pr.b IS NOT NULL GROUP BY pr.a, pr.b)
SELECT o.a, o.b, o.n AS both, i.n AS ink_a, j.n AS ink_b, o.n >= ceil(sqrt(CAST(CAST(0.92 AS FLOAT) AS DOUBLE) * i.n * j.n)) AS match FROM o JOIN tot i ON i.doc_id = o.a JOIN tot j ON j.doc_id = o.b""", "codes", "px")
def correlation_wide(spark, sf_dir):
    pairs, rows = _neighbours(spark, sf_dir)
    return sym.correlated(pairs.withColumn("dx", F.lit(-35)).withColumn("dy", F.lit(2)), rows, 0.92).select("a", "b", "both", "ink_a", "ink_b", "match")


@query("placement_wide", f"""+ {_NEXT}, st AS (SELECT dx, dy, 3 * (dy + 1) + dx + 1 AS rank FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
o AS (SELECT pr.a, pr.b, dx, dy, rank, count(q.x) AS n FROM pr CROSS JOIN st LEFT JOIN ink p ON p.doc_id = pr.a LEFT JOIN ink q ON q.doc_id = pr.b AND q.x = p.x - dx AND q.y = p.y - dy WHERE pr.b IS NOT NULL GROUP BY pr.a, pr.b, dx, dy, rank),
d AS (SELECT o.a, o.b, dx, dy, rank, i.n + j.n - 2 * o.n AS differs FROM o JOIN tot i ON i.doc_id = o.a JOIN tot j ON j.doc_id = o.b), m AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY differs, rank) AS r FROM d) SELECT a, b, dx, dy, differs FROM m WHERE r = 1""", "codes", "px")
def placement_wide(spark, sf_dir):
    return sym.refined(*_neighbours(spark, sf_dir))


@query("placement_refined", f"""+ {_EV}, st AS (SELECT dx, dy, 3 * (dy + 1) + dx + 1 AS rank FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
o AS (SELECT ev.key AS a, ev.prev AS b, dx, dy, rank, count(q.key) AS n FROM ev CROSS JOIN st LEFT JOIN bits p ON p.key = ev.key LEFT JOIN bits q ON q.key = ev.prev AND q.x = p.x - dx AND q.y = p.y - dy WHERE ev.prev IS NOT NULL GROUP BY ev.key, ev.prev, dx, dy, rank),
d AS (SELECT a, b, dx, dy, rank, i.n + j.n - 2 * o.n AS differs FROM o JOIN ink i ON i.key = a JOIN ink j ON j.key = b), m AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY differs, rank) AS r FROM d) SELECT a, b, dx, dy, differs FROM m WHERE r = 1""", "codes")
def placement_refined(spark, sf_dir):
    return sym.refined(*_event_bitmaps(spark, sf_dir))


@query("gray_alpha", "SELECT vec_id, x, CAST(CASE WHEN a = 255 THEN gr ELSE (gr * a + 255 * (255 - a) + 127) // 255 END AS BIGINT) AS g FROM rgba", "rgba")
def gray_alpha(spark, sf_dir):
    return pixels.gray_of(fx.rgba(spark, sf_dir), "GrayAlpha16").select("vec_id", "x", "g")


@query("log2up", "SELECT n, CAST(CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END AS BIGINT) AS bits FROM (SELECT unnest(range(0, 5000)) AS n)")
def log2up(spark, sf_dir):
    return spark.range(5000).select(F.col("id").alias("n"), scalar.bits_for(F.col("id")).alias("bits"))


@query("dpi_ppm", "SELECT d AS dpi, CAST(CASE WHEN d <= 0 THEN 0 ELSE round_even(d / 0.0254::DOUBLE, 0) END AS BIGINT) AS ppm FROM (SELECT unnest(range(-2, 3000)) AS d)")
def dpi_ppm(spark, sf_dir):
    return spark.range(-2, 3000).select(F.col("id").alias("dpi"), scalar.pixels_per_metre(F.col("id")).alias("ppm"))


@query("dpi_units", """SELECT v, unit, CAST(CASE WHEN s >= 1 AND s < 100000 THEN round_even(s, 0) ELSE 0 END AS BIGINT) AS dpi FROM (SELECT v, unit, CASE unit WHEN 'inch' THEN v WHEN 'cm' THEN v * 2.54::DOUBLE WHEN 'm' THEN v * 0.0254::DOUBLE WHEN 'mm' THEN CASE WHEN v <> 1.0 THEN v * 25.4::DOUBLE ELSE 0 END ELSE 0 END AS s
FROM (SELECT CAST(unnest(range(0, 4000)) AS DOUBLE) / 4 AS v), (SELECT unnest(['inch', 'cm', 'm', 'mm', 'aspect']) AS unit))""")
def dpi_units(spark, sf_dir):
    rows = spark.range(4000).select((F.col("id").cast("double") / 4).alias("v"), F.explode(F.array(*map(F.lit, ("inch", "cm", "m", "mm", "aspect")))).alias("unit"))
    return rows.withColumn("dpi", scalar.dpi_of(F.col("v"), F.col("unit")))


# --- framing and coding -------------------------------------------------------------------------------------------


@query("segment_headers", """SELECT n AS number, p AS page, upper(printf('%08x', n) || printf('%02x', CASE WHEN p > 255 THEN 70 ELSE 6 END) || '42' || CASE WHEN n <= 256 THEN printf('%02x', n - 1) || printf('%02x', n - 2) WHEN n <= 65536 THEN printf('%04x', n - 1) || printf('%04x', n - 2) ELSE printf('%08x', n - 1) || printf('%08x', n - 2) END || CASE WHEN p > 255 THEN printf('%08x', p) ELSE printf('%02x', p) END || printf('%08x', n + p)) AS header
FROM (SELECT unnest([2, 100, 255, 256, 257, 300, 65535, 65536, 65537, 1000000]) AS n), (SELECT unnest(range(1, 400)) AS p)""")
def segment_headers(spark, sf_dir):
    rows = spark.range(1, 400).select(F.explode(F.array(*(F.lit(n).cast("int") for n in (2, 100, 255, 256, 257, 300, 65535, 65536, 65537, 1000000)))).alias("number"), F.col("id").alias("page"))
    head = segments.header_column(F.col("number").cast("long"), F.lit(segments.TEXT), F.col("page"), F.col("number") + F.col("page"), F.array(F.col("number") - 1, F.col("number") - 2), F.lit(2))
    return rows.withColumn("header", F.hex(head))


@query("file_layout", """+ h AS (SELECT doc_id, CAST(max(y) + 1 AS BIGINT) AS h FROM px GROUP BY doc_id)
SELECT doc_id, upper('974a42320d0a1a0a0100000001' || '00000000300001' || '00000013' || printf('%08x', 64) || printf('%08x', h) || printf('%08x', 11811) || printf('%08x', 11811) || '010000' || printf('%08x', 64) || printf('%08x', h) || '000000000000000000' || '00' || '03fffdff02fefefe') AS head FROM h""", "codes", "px")
def file_layout(spark, sf_dir):
    rows = fx.doc_codes(spark, sf_dir).select("doc_id", scalar.div(F.size("codes").cast("long"), _W).alias("h"))
    metres, zero = scalar.pixels_per_metre(F.lit(300)), F.lit(0).cast("long")
    head = F.concat(
        segments.file_header_column(F.lit(1)),
        segments.header_column(zero, F.lit(segments.PAGE), F.lit(1).cast("long"), F.lit(19), F.array().cast("array<long>"), F.lit(0)),
        segments.page_information_column(F.lit(_W), F.col("h"), metres, metres, F.lit(True)),
        segments.generic_header_column(F.lit(_W), F.col("h"), F.lit(False)),
    )
    return rows.select("doc_id", F.hex(head).alias("head"))


@query("mq_h2", "SELECT '84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC' AS coded")
def mq_h2(spark, sf_dir):
    import pyarrow as pa

    def run(batches):
        import numpy as np

        from inkplan.functions import mq

        for batch in batches:
            out = [mq.encode(np.zeros(256), np.unpackbits(np.frombuffer(bytes.fromhex(t), np.uint8))).hex().upper() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out)], ["coded"])

    # The test sequence of T.88 annex H.2
    return spark.range(1).select(F.lit("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF").alias("t")).mapInArrow(run, "coded string")


def _file(encoded: DataFrame) -> DataFrame:
    return document.whole_file(encoded).select("doc_id", F.octet_length("file").cast("long").alias("bytes"), F.sha2("file", 256).alias("sha256"))


@query("encode_lossless")
def encode_lossless(spark, sf_dir):
    return _file(document.encode(fx.doc_pages(spark, sf_dir), Encoding(dpi=300)))


@query("encode_tpgd")
def encode_tpgd(spark, sf_dir):
    return _file(document.encode(fx.doc_pages(spark, sf_dir), Encoding(duplicate_lines=True)))


@query("encode_lossy")
def encode_lossy(spark, sf_dir):
    return _file(document.encode(fx.event_pages(spark, sf_dir), Encoding(mode="lossy")))


@query("encode_pdf")
def encode_pdf(spark, sf_dir):
    done = document.encode(fx.event_pages(spark, sf_dir), Encoding(mode="lossy", output="embedded", merge=True))
    return document.pdf_file(done).select("doc_id", F.octet_length("file").cast("long").alias("bytes"), F.sha2("file", 256).alias("sha256"))


@query("classify")
def classify(spark, sf_dir):
    return document.classify(fx.event_pages(spark, sf_dir))


@query("merge_hash")
def merge_hash(spark, sf_dir):
    return document.classify(fx.event_pages(spark, sf_dir), Encoding(mode="lossy", merge=True)).groupBy("doc_id").agg(F.countDistinct("class_no").alias("classes"))


@query("merge_all")
def merge_all(spark, sf_dir):
    return document.classify(fx.event_pages(spark, sf_dir), Encoding(mode="lossy", merge=True, merge_by_hash=False)).groupBy("doc_id").agg(F.countDistinct("class_no").alias("classes"))


@query("ink_statistics", f"SELECT doc_id, CAST(max(y) + 1 AS BIGINT) AS height, CAST(sum(({_INK})::INT) AS BIGINT) AS black FROM px GROUP BY doc_id", "codes", "px")
def ink_statistics(spark, sf_dir):
    """The flagship: per page, its rows and its ink."""
    rows = fx.doc_rows(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.max(F.col("y") + 1).alias("height"), F.sum(scalar.black_count(F.col("words"))).alias("black"))
