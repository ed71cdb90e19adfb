"""Line dedup by overlapping three-line windows.

A document of fewer lines is one window of its own kind. Every three consecutive lines are hashed, windows that occur more than once anywhere are found, and all their
occurrences but the first - by doc_id, then place - are removed: the lines that they cover, merged, go. Only hashes and
places are shuffled to find them; a window's count and first place are merged before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, scratch, stored

WINDOW = 3


def dedup_lines(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (array of first and past the last line, from 0), text (null if it was) of every row.

    Lines end at \\n. Windows of blank lines alone don't count. A document of fewer lines than a window is compared as a
    whole with other such documents, and loses all its lines where an earlier one is equal. Null and empty texts lose nothing. Null doc_ids
    come first. Rows of the same doc_id and text are one document: they lose the same lines. Texts are read whole, however
    long. An empty table gives no rows; other columns, whatever their names, are ignored.
    """
    base = scratch(documents.sparkSession, "lines")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("text"))
    lines = F.split("text", "\n", -1)
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("lines") - window),
        lambda i: F.struct(*(F.xxhash64(F.lit(s), *(F.col("lines")[i + k] for k in range(window))).alias(f"h{s}") for s in (1, 2)), (F.trim(F.concat(*(F.col("lines")[i + k] for k in range(window)))) != "").alias("solid")),
    )
    # hashed with one value more, so that they meet windows of their own kind alone
    short = F.array(F.struct(*(F.xxhash64(F.lit(s), F.lit("short"), "text").alias(f"h{s}") for s in (1, 2)), (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) != "").alias("solid")))
    own = F.when(F.size("lines") >= window, hashed).otherwise(short)
    windows = docs.where("text is not null").withColumn("lines", lines).select("doc_id", "row", F.posexplode(own).alias("at", "w")).where("w.solid").select("doc_id", "row", "at", "w.h1", "w.h2")
    windows = stored(windows, f"{base}/windows")
    place = F.struct("doc_id", "row", "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    later = windows.join(first, ["h1", "h2"]).where(place > F.col("first")).select("doc_id", "row", "at").distinct()
    covered = stored(later.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("starts")), f"{base}/covered")
    # documents that lose nothing are passed on as they are; only the others (and a few more) are joined, and their texts shuffled
    held = IdFilter(covered, "row", covered.count())

    @F.pandas_udf("boolean")
    def touched(row: pd.Series) -> pd.Series:
        return pd.Series(held.holds(row.to_numpy(np.int64)))

    docs = docs.withColumn("touched", touched("row"))
    gone = covered.select(F.col("doc_id").alias("__doc_id"), F.col("row").alias("__row"), "starts")
    some = docs.where("touched")
    joined = some.join(gone, some["doc_id"].eqNullSafe(gone["__doc_id"]) & (some["row"] == gone["__row"]), "left").select("doc_id", "text", "starts")
    joined = joined.unionByName(docs.where("not touched").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts")))
    # starts that lie at most a window apart merge into one stretch
    merged = F.aggregate(
        F.coalesce("starts", F.array().cast("array<int>")),
        F.array().cast("array<struct<first:int,past:int>>"),
        lambda spans, a: F.when(
            (F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["past"] >= a),
            F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(spans, F.lit(-1))["first"].alias("first"), (a + window).alias("past")))),
        ).otherwise(F.concat(spans, F.array(F.struct(a.alias("first"), (a + window).alias("past"))))),
    )
    out = joined.withColumn("removed", merged).withColumn("lines", F.coalesce(lines, F.array().cast("array<string>")))
    kept = F.filter("lines", lambda x, i: ~F.exists("removed", lambda s: (s["first"] <= i) & (i < s["past"])))
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    # a short document's stretch ends with it
    removed = F.transform("removed", lambda s: F.struct(s["first"].alias("first"), F.least(s["past"], F.size("lines")).alias("past")))
    dropped = F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_removed"), removed.alias("removed"), text.alias("text"))
