"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length, each as often as it may be copied. A source's budget takes the same part of every
length and is topped up in a seeded order; then some of what was taken is freed again, several times the longest length,
and bounded-knapsack dynamic programming over all lengths that are free fits that part. If no sum of them is exact, twice
as much is freed, in the end everything. Copies of a length are dealt evenly over its documents, one more for those that a
seeded hash puts first. Only counts by length, never documents, meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, scratch, stored

#: Words that the dynamic program fits at first, and how many times the longest length these are at least.
FIT_WORDS, FIT_LENGTHS = 1 << 13, 4
#: Words beyond which the program is not widened again to turn a near sum into an exact one (it takes 5 bytes a word).
WIDE_WORDS = 1 << 25
#: Copies of a document at most.
MOST_COPIES = 3


def word_count(text: str = "text") -> F.Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _ranked(per: DataFrame, column: str, folder: str) -> DataFrame:
    """per with rank: the place of each row, from 0, in the order of column by code point, null last; sorted in ranges, not in one task."""
    parts = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(column).asc_nulls_last()
    ranged = stored(per.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), folder)
    before = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    # one row for each range
    before = before.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).drop("rows")
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.join(before, "part").withColumn("rank", F.col("before") + own).drop("part", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target. sizes: source, size. Weights repeat over the sources by code point, null last.

    A target stops at cap times its source's size and the excess is shared anew by weight, until none is above: each round
    is one aggregation over the sources, of which there may be any number. No sources: no rows.
    """
    base = scratch(sizes.sparkSession, "sources")
    per = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source", f"{base}/ranged")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = stored(per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("most")), f"{base}/sources")
    total, weight_sum = per.agg(F.sum("source_size"), F.sum("weight")).first()
    share = total / weight_sum if weight_sum else 0.0
    while True:
        over = F.col("weight") * F.lit(float(share)) >= F.col("most")
        capped, left = per.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if capped is None or not left or (again := (total - capped) / left) <= share:
            break
        share = again
    return per.select("source", "source_size", F.when(over, F.col("most")).otherwise(F.col("weight") * F.lit(float(share))).alias("target"))


def _fitted(lengths: np.ndarray, free: np.ndarray, budget: int, over: int) -> tuple[np.ndarray, int]:
    """How many of each length (free[i] at most) give the sum nearest to budget, up to `over` words above it, and that sum."""
    most = budget + over
    # the step by which each sum is reached first; 0 is reached without
    by = np.full(most + 1, -1, np.int32)
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        # powers of two and a rest cover every number up to the bound
        bound, size = min(int(free[i]), most // int(lengths[i])), 1
        while bound and not reach[budget]:
            size = min(size, bound)
            by_words = size * int(lengths[i])
            new = np.flatnonzero(reach[: most + 1 - by_words] & ~reach[by_words:]) + by_words
            if len(new):
                reach[new], by[new] = True, len(steps)
                steps.append((int(i), size))
            bound -= size
            size *= 2
        if reach[budget]:
            break
    below = budget - int(reach[budget::-1].argmax())
    at = below
    if below < budget and reach[budget + 1 :].any() and (above := budget + 1 + int(reach[budget + 1 :].argmax())) - budget < budget - below:
        at = above
    used, rest = np.zeros(len(lengths), np.int64), at
    while rest:
        # a sum was reached from one that an earlier step had reached
        i, size = steps[by[rest]]
        used[i] += size
        rest -= size * int(lengths[i])
    return used, at


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that their sum comes nearest to budget; of two equally near, the smaller.

    lengths: distinct, positive, with counts documents each. The sum is the nearest of all wherever it is exact or all
    documents came to be freed, which takes budgets over WIDE_WORDS words to miss; then it is the nearest that the freed ones allow.
    """
    total = int((lengths * counts).sum())
    budget = max(0, min(budget, total))
    if budget == total:
        return counts.copy()
    # the same part of every length, then one more of each in a seeded order while it fits
    take = np.floor(counts * (budget / total)).astype(np.int64)
    left = budget - int((lengths * take).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:
        if take[i] < counts[i] and lengths[i] <= left:
            take[i] += 1
            left -= int(lengths[i])
    longest, step = int(lengths.max()), int(np.gcd.reduce(lengths))
    goal = max(FIT_WORDS, FIT_LENGTHS * longest)
    while True:
        # free some of what was taken, one of each length in turn, so that the program has lengths to choose from
        while left < goal and take.any():
            for i in order:
                if take[i] and left < goal:
                    take[i] -= 1
                    left += int(lengths[i])
        used, at = _fitted(lengths, counts - take, left, longest)
        # all sums are multiples of step
        if abs(at - left) <= min(left % step, step - left % step) or not take.any() or 2 * goal > WIDE_WORDS:
            return take + used
        goal *= 2


def row_hash(seed: int = 0) -> F.Column:
    """What orders and names the rows: equal only for rows of the same doc_id, source and text."""
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text")


def mixture(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 0) -> DataFrame:
    """The mix itself: the documents with all their columns, whatever their names, each row as often as mix() takes it.

    Texts are shuffled once, with their copies; only rows that repeat doc_id, source and text are compared as rows.
    """
    c = fresh(documents, "mix")
    copies = mix(documents, weights, seed).groupBy("doc_id", "h").agg(F.sum("copies").alias(f"{c}_copies"), F.count("*").alias(f"{c}_rows")).where(f"{c}_copies > 0").withColumnsRenamed({"doc_id": f"{c}_doc_id", "h": f"{c}_h"})
    own = documents.withColumn(f"{c}_own", row_hash(seed))
    rows = own.join(copies, (F.col(f"{c}_own") == F.col(f"{c}_h")) & documents["doc_id"].cast("long").eqNullSafe(F.col(f"{c}_doc_id")))
    rows = rows.where(f"{c}_rows = 1").unionByName(rows.where(f"{c}_rows > 1").dropDuplicates([f"{c}_doc_id", f"{c}_own"]))
    return rows.withColumn(f"{c}_n", F.explode(F.sequence(F.lit(1).cast("long"), f"{c}_copies"))).select(*documents.columns)


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), seed: int = 0) -> DataFrame:
    """doc_id, h (row_hash), source, size, source_size, target, copies, taken (= size * copies) of every row.

    Null text: size 0, never taken, as are texts without words. Null source: a source of its own, last. Null doc_ids are kept. Ties between
    documents go by a seeded hash of doc_id, source and text; rows that repeat in all of these are interchangeable. A very
    long text is one document: a source of few of them gets the nearest sum that whole copies reach. An empty table
    gives no rows. Other columns, whatever their names, are ignored.
    """
    spark = documents.sparkSession
    base = scratch(spark, "mix")
    docs = stored(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), row_hash(seed).alias("h")),
        f"{base}/sizes",
    )
    wanted = stored(targets(docs, weights), f"{base}/targets")
    lengths = docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        # a document stands for as many as it may be copied
        n = rows["n"].to_numpy(np.int64)
        copies = fit_counts(rows["size"].to_numpy(np.int64), n * MOST_COPIES, round(float(rows["target"].iloc[0])), seed)
        rows["whole"], rows["extra"] = copies // n, copies % n
        return rows[["source", "size", "whole", "extra"]]

    fitted = stored(
        lengths.join(wanted, lengths["source"].eqNullSafe(wanted["source"])).select(lengths["source"], "size", "n", "source_size", "target")
        .groupBy("source").applyInPandas(fit, "source string, size long, whole long, extra long"),
        f"{base}/fitted",
    )
    # the extra copies go to the least hashes of each length: ranked by bucket first, so that no length is sorted in one task
    buckets = 12
    cell = docs.where("size > 0").withColumn("b", F.shiftright("h", 64 - buckets))
    before = (
        cell.groupBy("source", "size", "b").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("b")) - F.col("n"))
    )
    # only the bucket in which the last extra copy falls has to be ranked
    edge = before.alias("x").join(fitted.alias("f"), F.expr("x.source <=> f.source and x.size = f.size")).select("x.source", "x.size", "x.b", (F.col("extra") - F.col("before")).alias("room"), "x.n", "whole")
    joined = cell.alias("c").join(edge.alias("e"), F.expr("c.source <=> e.source and c.size = e.size and c.b = e.b")).select("c.doc_id", "c.source", "c.size", "c.h", "c.b", "room", "n", "whole")
    clear = joined.where("room <= 0 or room >= n").select("doc_id", "h", "source", "size", (F.col("whole") + (F.col("room") > 0).cast("long")).alias("copies"))
    ranked = joined.where("room > 0 and room < n").withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "b").orderBy("h", "doc_id")))
    parts = clear.unionByName(ranked.select("doc_id", "h", "source", "size", (F.col("whole") + (F.col("rank") <= F.col("room")).cast("long")).alias("copies")))
    parts = parts.unionByName(docs.where("size = 0").select("doc_id", "h", "source", "size", F.lit(0).cast("long").alias("copies")))
    return parts.alias("p").join(wanted.alias("w"), F.expr("p.source <=> w.source")).select("doc_id", "h", "p.source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
