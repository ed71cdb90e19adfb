"""Bitmaps as relations of rows (doc_id, y, words): 32-bit words as longs, leftmost pixel highest, 1 = black, padding 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkplan.functions import scalar

_ALL = 0xFFFFFFFF
OPERATIONS = {
    "copy": lambda d, s: s,
    "or": lambda d, s: d.bitwiseOR(s),
    "and": lambda d, s: d.bitwiseAND(s),
    "xor": lambda d, s: d.bitwiseXOR(s),
    "andnot": lambda d, s: d.bitwiseAND(F.bitwise_not(s)),
}


def from_packed(rows: DataFrame, width: int, one_is_black: bool = True) -> DataFrame:
    """Rows with data binary (bytes, leftmost bit highest) to words; what lies beyond width is white."""
    size = -(-width // 8)
    data = F.when(F.octet_length("data") >= size, F.col("data")).otherwise(F.raise_error(F.lit("row is too short")).cast("binary"))
    whole = F.rpad(F.substring(F.hex(data), 1, 2 * size), 8 * -(-width // 32), "0")
    word = lambda k: F.conv(F.substr(whole, k * 8 + 1, F.lit(8)), 16, 10).cast("long")
    turned = (lambda w: w) if one_is_black else (lambda w: F.lit(_ALL).cast("long") - w)
    last = width % 32
    mask = lambda k, w: w.bitwiseAND(F.when(k == (width - 1) // 32, F.lit((_ALL << (32 - last)) & _ALL if last else _ALL)).otherwise(F.lit(_ALL)))
    return rows.withColumn("words", F.transform(F.sequence(F.lit(0), F.lit((width - 1) // 32)), lambda k: mask(k, turned(word(k))))).drop("data")


def to_packed(rows: DataFrame, width: int, one_is_black: bool = True) -> DataFrame:
    """Adds data: each row as bytes. With inverted polarity padding is 1, that is white."""
    words = F.transform("words", lambda w: F.lpad(F.hex(w if one_is_black else F.lit(_ALL).cast("long") - w), 8, "0"))
    return rows.withColumn("data", F.unhex(F.substring(F.array_join(words, ""), 1, 2 * -(-width // 8))))


def ink(rows: DataFrame, by: list[str]) -> DataFrame:
    """Black pixels of each bitmap, and whether it is blank."""
    return rows.groupBy(*by).agg(F.sum(scalar.black_count(F.col("words"))).alias("black")).withColumn("blank", F.col("black") == 0)


def equal(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Whether two bitmaps of the same key have the same pixels; a bitmap that one side lacks is different."""
    both = left.select(*by, "y", F.col("words").alias("p")).join(right.select(*by, "y", F.col("words").alias("q")), [*by, "y"], "full_outer")
    return both.groupBy(*by).agg(F.bool_and(F.col("p").eqNullSafe(F.col("q"))).alias("same"))


def moved(words: Column, width: int, dx: int, size: int) -> Column:
    """Words of a row of `size` pixels whose pixel x is pixel x - dx of the given row."""
    last = size % 32
    part = lambda k: scalar.word_window(words, F.lit(width), k * 32 - dx)
    return F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 32)), lambda k: part(k).bitwiseAND(F.when(k == (size - 1) // 32, F.lit((_ALL << (32 - last)) & _ALL if last else _ALL)).otherwise(F.lit(_ALL))))


def combine(target: DataFrame, source: DataFrame, operation: str, dx: int, dy: int, by: list[str], width: int) -> DataFrame:
    """target with source, moved by (dx, dy), combined in; source pixels that fall outside are clipped.

    Both bitmaps are `width` wide. Pixels of target that source does not reach stay as they are. One equi-join on the row.
    """
    moved_rows = source.select(*by, (F.col("y") + dy).alias("y"), moved(F.col("words"), width, dx, width).alias("other"))
    low, high = max(dx, 0), min(width + dx, width)
    mask = [0] * (-(-width // 32))
    for x in range(low, max(low, high)):
        mask[x // 32] |= 1 << (31 - x % 32)
    masks = F.array(*(F.lit(m).cast("long") for m in mask))
    step = OPERATIONS[operation]
    mixed = F.transform(F.arrays_zip(F.col("words").alias("d"), F.col("other").alias("s"), masks.alias("m")), lambda t: t["d"].bitwiseAND(F.bitwise_not(t["m"])).bitwiseOR(step(t["d"], t["s"]).bitwiseAND(t["m"])))
    return target.join(moved_rows, [*by, "y"], "left").withColumn("words", F.when(F.col("other").isNull(), F.col("words")).otherwise(mixed)).drop("other")


def _white(size: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), -(-size // 32))


def clip(rows: DataFrame, x: int, y: int, width: int, height: int, source_width: int, by: list[str] | None = None) -> DataFrame:
    """The window of that corner and size; columns outside are white. With by, rows above and below are white ones too, else they are left out."""
    inside = rows.where((F.col("y") >= y) & (F.col("y") < y + height)).withColumn("words", moved(F.col("words"), source_width, -x, width)).withColumn("y", F.col("y") - y)
    if by is None:
        return inside
    every = rows.select(*by).distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))))
    return every.join(inside, [*by, "y"], "left").withColumn("words", F.coalesce("words", _white(width)))


def bordered(rows: DataFrame, border: int, width: int, by: list[str] | None = None) -> DataFrame:
    """Moved right and down by border, and as wide as with white on both sides. With by, the white rows above and below come too."""
    inside = rows.withColumn("words", moved(F.col("words"), width, border, width + 2 * border)).withColumn("y", F.col("y") + border)
    if by is None or not border:
        return inside
    place = F.sequence(F.lit(0).cast("long"), F.lit(border - 1).cast("long"))
    around = rows.groupBy(*by).agg((F.max("y") + 1 + border).alias("below")).withColumn("y", F.explode(F.concat(place, F.transform(place, lambda k: k + F.col("below")))))
    return inside.select(*by, "y", "words").unionByName(around.select(*by, "y", _white(width + 2 * border).alias("words")))


def unbordered(rows: DataFrame, border: int, width: int, height: int | None = None) -> DataFrame:
    """Without the outer pixels on all sides. height: of the bordered bitmaps; None: each bitmap's own, if its white rows are there."""
    if height is not None:
        return clip(rows, border, border, width - 2 * border, height - 2 * border, width)
    by = [c for c in rows.columns if c not in ("y", "words")]
    last = F.max("y").over(Window.partitionBy(*by))
    inside = rows.withColumn("__last", last).where((F.col("y") >= border) & (F.col("y") <= F.col("__last") - border)).drop("__last")
    return inside.withColumn("words", moved(F.col("words"), width, -border, width - 2 * border)).withColumn("y", F.col("y") - border)


def runs(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(y, l, r) of the maximal runs of black pixels; pixels: by, x, y of black ones alone."""
    row = Window.partitionBy(*by, "y").orderBy("x")
    return pixels.withColumn("island", F.col("x") - F.row_number().over(row)).groupBy(*by, "y", "island").agg(F.min("x").alias("l"), F.max("x").alias("r")).drop("island")


def _pixels(words: pa.Array, width: int) -> np.ndarray:
    """Arrays of words to rows of 0 and 1."""
    flat = np.asarray(words.flatten(), np.int64).astype(">u4")
    return np.unpackbits(flat.view(np.uint8).reshape(len(words), -1), axis=1, count=width)


def runs_of_rows(rows: DataFrame, width: int, by: list[str]) -> DataFrame:
    """The same from rows of words, without pixels as rows: a narrow pass over Arrow batches."""
    from inkplan.functions import shapes

    names = [*by, "y"]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 65_536):
                part = batch.slice(at, 65_536)
                found = shapes.runs(_pixels(part.column("words"), width))
                own = pa.array(found[:, 0])
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(own) for c in names), pa.array(found[:, 1], pa.int64()), pa.array(found[:, 2], pa.int64())], [*names, "l", "r"])

    kinds = dict(rows.dtypes)
    return rows.select(*names, "words").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", l long, r long")


def typical_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """ltp: the row equals the one above (never the first); sltp: whether that changed, which is what is coded."""
    order = Window.partitionBy(*by).orderBy("y")
    same = F.coalesce(F.col("words") == F.lag("words").over(order), F.lit(False))
    flagged = rows.withColumn("ltp", same.cast("long"))
    return flagged.withColumn("sltp", F.col("ltp").bitwiseXOR(F.coalesce(F.lag("ltp").over(order), F.lit(0).cast("long"))))


def context_counts(rows: DataFrame, width: int, by: list[str]) -> DataFrame:
    """How often each generic-region context meets each bit: five pixels two rows up, seven above, four to the left."""
    order = Window.partitionBy(*by).orderBy("y")
    blank = F.transform("words", lambda w: F.lit(0).cast("long"))
    above = rows.select("words", F.coalesce(F.lag("words", 1).over(order), blank).alias("a"), F.coalesce(F.lag("words", 2).over(order), blank).alias("b"))

    def run(batches):
        from inkplan.functions import mq

        total = np.zeros(1 << 17, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 65_536):
                part = batch.slice(at, 65_536)
                own, *others = (_pixels(part.column(c), width) for c in ("words", "a", "b"))
                key = mq.neighbours_of(*others[::-1], own).astype(np.int64) << 1 | own
                total += np.bincount(key.reshape(-1), minlength=len(total))
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(key & 1), pa.array(total[key])], ["context", "bit", "n"])

    # counted per partition first
    return above.mapInArrow(run, "context long, bit long, n long").groupBy("context", "bit").agg(F.sum("n").alias("n"))
