"""Rasters and symbol relations derived from the tables, so that every operator can be queried; whole tables, no limits.

doc_*: a document's code points (mod 256) as gray, 64 to a row, the last row filled up with 255. emb_pages: embeddings as
gray rows, 512 vectors to a page. rgba: embedding triples as colors. glyphs: one symbol per character above the blank,
40 to a line and 800 to a page, its class and size taken from the code point.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplan.functions import overlaps, scalar

WIDTH = 64
INK, BLANK = 110, 33


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, codes: array of whole rows of levels."""
    docs = _table(spark, sf_dir, "documents").where(F.length("text") > 0)
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c).bitwiseAND(F.lit(255)).cast("long"))
    fill = F.array_repeat(F.lit(255).cast("long"), ((WIDTH - F.length("text") % WIDTH) % WIDTH).cast("int"))
    return docs.select("doc_id", F.concat(codes, fill).alias("codes"))


def doc_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, x, y, g."""
    at = F.col("pos").cast("long")
    return doc_codes(spark, sf_dir).select("doc_id", F.posexplode("codes").alias("pos", "g")).select("doc_id", (at % WIDTH).alias("x"), scalar.div(at, WIDTH).alias("y"), "g")


def doc_rows(spark: SparkSession, sf_dir: str, limit: int = INK) -> DataFrame:
    """doc_id, y, words: levels under limit are black."""

    def run(batches):
        for batch in batches:
            for piece in overlaps.text_pieces(batch, "text"):
                yield overlaps.text_rows(*piece.columns, WIDTH, limit)

    docs = _table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, y long, words array<long>")


def doc_pages(spark: SparkSession, sf_dir: str, limit: int = INK) -> DataFrame:
    """The same as pages for encoding."""
    import numpy as np

    def run(batches):
        for batch in batches:
            codes = [np.asarray(c.values) for c in batch.column("codes")]
            n = pa.array([len(c) // WIDTH for c in codes], pa.int32())
            same = lambda v: pa.array([v] * len(codes), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), same(0), same(WIDTH), n, same(0), same(0), pa.array([np.packbits(c < limit).tobytes() for c in codes], pa.binary())], ["doc_id", "page_no", "width", "height", "x_dpi", "y_dpi", "packed"])

    return doc_codes(spark, sf_dir).mapInArrow(run, "doc_id long, page_no int, width int, height int, x_dpi int, y_dpi int, packed binary")


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of 8 x 8 bits per event; the document is the user, pages are in order of time."""
    from pyspark.sql import Window

    events = _table(spark, sf_dir, "events")
    page = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    bit = lambda x, y: F.shiftright(F.col("event_id") * 2654435761 + y * 40503 + x * 2246822519, 7).bitwiseAND(F.lit(1))
    row = lambda y: sum((bit(F.lit(x), F.lit(y)) * (1 << (7 - x)) for x in range(8)), F.lit(0))
    data = F.unhex(F.concat(*(F.lpad(F.hex(row(y).cast("long")), 2, "0") for y in range(8))))
    return events.select(F.col("user_id").cast("long").alias("doc_id"), page.alias("page_no"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(300).alias("x_dpi"), F.lit(300).alias("y_dpi"), data.alias("packed"))


def _level(v) -> F.Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(255).cast("long"), F.floor((v.cast("double") + F.lit(0.6)) * F.lit(212.5)).cast("long")))


def emb_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_no, x, y, g."""
    rows = _table(spark, sf_dir, "embeddings").select(scalar.div(F.col("vec_id"), 512).alias("page_no"), (F.col("vec_id") % 512).alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("page_no", F.col("x").cast("long").alias("x"), "y", _level(F.col("v")).alias("g"))


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x, r, gr, b, a."""
    q = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", _level).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"))
    at = lambda i: F.get("q", i.cast("int"))
    return q.select("vec_id", F.col("x").cast("long").alias("x"), at(F.col("x") * 3).alias("r"), at(F.col("x") * 3 + 1).alias("gr"), at(F.col("x") * 3 + 2).alias("b"), F.when(F.col("x") < 16, at(63 - F.col("x"))).otherwise(255).cast("long").alias("a"))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, comp_no, class_no, w, h, ul_x, ul_y, all long."""
    chars = _table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "")).alias("i", "ch")).select("doc_id", F.col("i").cast("long").alias("i"), F.ascii("ch").cast("long").alias("cp")).where("cp > 32")
    kind, i = F.col("cp") % 97, F.col("i")
    return chars.select("doc_id", scalar.div(i, 800).alias("page_no"), i.alias("comp_no"), kind.alias("class_no"), (kind % 7 + 5).alias("w"), (kind % 5 + 7).alias("h"), ((i % 40) * 14).alias("ul_x"), (scalar.div(i % 800, 40) * 18 + kind % 3).alias("ul_y"))


#: The same relations for DuckDB, as common table expressions.
SQL = {
    "codes": "codes AS (SELECT doc_id, list_concat(list_transform(string_split(text, ''), lambda c: unicode(c) & 255), list_transform(range(0, (64 - length(text) % 64) % 64), lambda z: 255)) AS c FROM documents WHERE length(text) > 0)",
    "px": "px AS (SELECT doc_id, i % 64 AS x, i // 64 AS y, g FROM (SELECT doc_id, unnest(c) AS g, generate_subscripts(c, 1) - 1 AS i FROM codes))",
    "emb": "emb AS (SELECT vec_id // 512 AS page_no, x, vec_id % 512 AS y, greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE) + 0.6::DOUBLE) * 212.5::DOUBLE) AS BIGINT))) AS g FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding) AS v FROM embeddings))",
    "rgba": "rgba AS (SELECT vec_id, i AS x, q[3 * i + 1] AS r, q[3 * i + 2] AS gr, q[3 * i + 3] AS b, CASE WHEN i < 16 THEN q[64 - i] ELSE 255 END AS a FROM (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor((CAST(v AS DOUBLE) + 0.6::DOUBLE) * 212.5::DOUBLE) AS BIGINT)))) AS q, unnest(range(0, 21)) AS i FROM embeddings))",
    "glyphs": "glyphs AS (SELECT doc_id, i // 800 AS page_no, i AS comp_no, cp % 97 AS class_no, cp % 97 % 7 + 5 AS w, cp % 97 % 5 + 7 AS h, (i % 40) * 14 AS ul_x, ((i % 800) // 40) * 18 + cp % 97 % 3 AS ul_y FROM (SELECT doc_id, CAST(unicode(ch) AS BIGINT) AS cp, i FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents WHERE length(text) > 0)) WHERE cp > 32)",
}
