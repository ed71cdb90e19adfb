"""Symbol relations of documents: candidates by size, uses, dictionaries, order and deltas of what is coded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from inkplan.functions import overlaps as kernels
from inkplan.functions import scalar
from inkplan.functions.shapes import WALK


def size_candidates(instances: DataFrame, templates: DataFrame, by: list[str]) -> DataFrame:
    """Pairs whose sizes differ by two pixels at most, with the rank of their difference in the search order.

    The 25 differences are exploded on the instances' side, so this is an equi-join on the size, not a range join.
    """
    walk = F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for r, (dx, dy) in enumerate(WALK))))
    wanted = instances.withColumn("walk", walk).withColumn("w", F.col("w") + F.col("walk.dx")).withColumn("h", F.col("h") + F.col("walk.dy")).withColumn("rank", F.col("walk.rank")).drop("walk")
    return wanted.where("w > 0 and h > 0").join(templates, [*by, "w", "h"])


def uses(instances: DataFrame, by: list[str]) -> DataFrame:
    return instances.groupBy(*by, "class_no").agg(F.count("*").alias("uses"))


def shared(instances: DataFrame, by: list[str]) -> DataFrame:
    """Classes used more than once, or all of a document of one page."""
    pages = instances.groupBy(*by).agg((F.max("page_no") == F.min("page_no")).alias("single"))
    return uses(instances, by).join(pages, by).where((F.col("uses") > 1) | F.col("single")).drop("single")


def page_only(instances: DataFrame, by: list[str]) -> DataFrame:
    """The other classes, at their page, numbered in order of their component."""
    own = instances.join(shared(instances, by), [*by, "class_no"], "left_anti")
    order = Window.partitionBy(*by, "page_no").orderBy("comp_no")
    return own.select(*by, "page_no", "class_no", (F.row_number().over(order) - 1).cast("long").alias("ord"))


def dictionary(symbols: DataFrame, by: list[str]) -> DataFrame:
    """symbols: by, class_no, w, h, ord. Adds id (by height, width, ord) and what is coded: dh at a new height, dw."""
    order = Window.partitionBy(*by).orderBy("h", "w", "ord")
    level = Window.partitionBy(*by, "h").orderBy("w", "ord")
    before = F.coalesce(F.lag("h").over(order), F.lit(0).cast("long"))
    return symbols.withColumns({"id": (F.row_number().over(order) - 1).cast("long"), "dh": F.col("h") - before, "dw": F.col("w") - F.coalesce(F.lag("w").over(level), F.lit(0).cast("long"))})


def text_order(instances: DataFrame, by: list[str]) -> DataFrame:
    """Adds place: by lower-left y, x, component."""
    return instances.withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy("ll_y", "ll_x", "comp_no")) - 1).cast("long"))


def strip_deltas(instances: DataFrame, by: list[str]) -> DataFrame:
    """Adds dt (from the strip above, at the first of a strip) and ds: from the first of the strip above, or from the end of the symbol before."""
    # one sort: the first of a strip is where ll_y changes, and the one before it is the last such place
    order = Window.partitionBy(*by).orderBy("ll_y", "ll_x", "comp_no")
    earlier, zero = order.rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("long")
    rows = instances.withColumns({"__y": F.lag("ll_y").over(order), "__end": F.lag(F.col("ll_x") + F.col("w") - 1).over(order)})
    rows = rows.withColumn("__new", F.coalesce(F.col("__y") != F.col("ll_y"), F.lit(True)))
    before = F.last(F.when(F.col("__new"), F.col("ll_x")), ignorenulls=True).over(earlier)
    ds = F.when(F.col("__new"), F.col("ll_x") - F.coalesce(before, zero)).otherwise(F.col("ll_x") - F.col("__end"))
    return rows.withColumns({"dt": F.when(F.col("__new"), F.col("ll_y") - F.coalesce("__y", zero)), "ds": ds}).drop("__y", "__end", "__new")


def class_ids(instances: DataFrame, by: list[str]) -> DataFrame:
    """by, class_no, id of every class: of the shared dictionary, or of its page's own, counted on from it.

    The classes of a document are few; everything but one aggregation is done on them. A class of one page alone is
    used once, so its page is known. Shared classes are ordered by height, width and number, others by height, width and component.
    """
    classes = instances.groupBy(*by, "class_no").agg(F.count("*").alias("uses"), F.min("page_no").alias("page"), F.max("page_no").alias("last"), F.min("comp_no").alias("comp"), F.first("w").alias("w"), F.first("h").alias("h"))
    document = Window.partitionBy(*by)
    classes = classes.withColumn("common", (F.col("uses") > 1) | (F.min("page").over(document) == F.max("last").over(document)))
    classes = classes.withColumn("count", F.sum(F.col("common").cast("long")).over(document))
    own = lambda a, b: F.when(F.col("common"), a).otherwise(b)
    place = F.row_number().over(Window.partitionBy(*by, "common", own(F.lit(-1).cast("long"), F.col("page"))).orderBy("h", "w", own(F.col("class_no"), F.col("comp")))) - 1
    return classes.select(*by, "class_no", (place + own(F.lit(0).cast("long"), F.col("count"))).cast("long").alias("id"))


def symbol_ids(instances: DataFrame, global_ids: DataFrame, local_ids: DataFrame, by: list[str]) -> DataFrame:
    """instances with id: that of the shared dictionary, or the page's own, counted on from it; a symbol in neither fails.

    global_ids: by, class_no, id. local_ids: by, page_no, class_no, id.
    """
    count = global_ids.groupBy(*by).agg(F.count("*").alias("shared"))
    joined = (
        instances.join(global_ids.withColumnRenamed("id", "g"), [*by, "class_no"], "left")
        .join(local_ids.withColumnRenamed("id", "l"), [*by, "page_no", "class_no"], "left").join(count, by, "left")
    )
    lost = F.raise_error(F.concat(F.lit("symbol in no dictionary: "), F.col("class_no").cast("string"))).cast("long")
    return joined.withColumn("id", F.coalesce("g", F.col("l") + F.coalesce("shared", F.lit(0)), lost)).drop("g", "l", "shared")


def lower_left(instances: DataFrame) -> DataFrame:
    return instances.withColumn("ll_x", F.col("ul_x")).withColumn("ll_y", F.col("ul_y") + F.col("h") - 1)


def shift_between(a: str, b: str):
    """Rounded difference of two single-precision centroids."""
    return scalar.round_away(F.col(a) - F.col(b))


def _met(pairs: DataFrame, rows: DataFrame, columns: str, kernel, every: bool = False) -> DataFrame:
    """pairs with the named columns, which kernel makes from a batch of pairs and their bitmaps; every: a bitmap without rows is white, else its pairs go.

    A pair is one row, a bitmap one value. Joined by sorting: from the files' size Spark takes exploded rows for few, however
    many they are, and would gather them on the driver.
    """
    more = StructType.fromDDL(columns)
    names, schema = pairs.columns, StructType([*pairs.schema.fields, *more.fields])

    def pack(batches):
        for batch in batches:
            yield kernels.pack_rows(batch)

    def run(batches):
        for batch in batches:
            for piece in kernels.pieces(batch):
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], *map(pa.array, kernel(piece))], schema.names)

    key = StructType([StructField("key", rows.schema["key"].dataType), StructField("part", BinaryType())])
    parts = rows.where("key is not null").select("key", F.col("y").cast("long").alias("y"), F.col("words").cast("array<long>").alias("words")).mapInArrow(pack, key)
    whole, met = parts.groupBy("key").agg(F.collect_list("part").alias("bits")), pairs
    for side in ("a", "b"):
        own = whole.select(F.col("key").alias(side), F.col("bits").alias(f"bits_{side}"))
        met = met.join(own.hint("merge"), side, "left" if every else "inner")
    return met.select(*names, "bits_a", "bits_b").mapInArrow(run, schema)


def _moved(piece: pa.RecordBatch) -> tuple[kernels.Pairs, np.ndarray]:
    dx, dy = (np.asarray(piece.column(c), np.int64) for c in ("dx", "dy"))
    found = kernels.Pairs(piece.column("bits_a"), piece.column("bits_b"), (int(abs(dy).max()), int(abs(dx).max())))
    return found, found.shared(dx, dy)


def overlaps(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b, dx, dy, anything else) with both: ink of bitmap a that bitmap b, moved by (dx, dy), shares.

    rows: key, y, words - bitmaps of any width, one row for each y; no ink where a bitmap has no rows.
    """
    return _met(pairs, rows, "both long", lambda piece: [_moved(piece)[1]], every=True)


def correlated(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """overlaps() with both inks and match: whether both ** 2 reaches threshold (single precision) times the product of the inks; pairs of bitmaps with rows alone."""

    def kernel(piece):
        found, both = _moved(piece)
        return both, found.ink_a, found.ink_b

    need = F.ceil(F.sqrt(F.lit(threshold).cast("float").cast("double") * F.col("ink_a") * F.col("ink_b"))).cast("long")
    return _met(pairs, rows, "both long, ink_a long, ink_b long", kernel).withColumn("match", F.col("both") >= need)


def refined(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, dx, dy: the move by at most a pixel under which the two differ least; the first of equals, rows from above."""

    def kernel(piece):
        dx, dy, differs = kernels.Pairs(piece.column("bits_a"), piece.column("bits_b"), (1, 1)).best()
        return dx.astype(np.int32), dy.astype(np.int32), differs

    return _met(pairs.select("a", "b"), rows, "dx int, dy int, differs long", kernel)
