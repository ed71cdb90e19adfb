"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes, the widest first. Tiles hold neighbouring vectors of one label: cells
of the two leading axes that are as wide as two linked vectors can lie apart, cut into tiles of a fixed size, so linked
vectors are in the same cell or in adjacent ones. Two tiles whose boxes on the leading axes lie too far apart are never
compared. A comparison adds up products over the leading axes first; what the other axes can add is bounded by the
product of suffix norms, and rows, columns and at last the whole tile pair are left as soon as no cosine in them can
reach the threshold. What remains is verified in double precision on the vectors as given.

Equal vectors of a label are one node with a count, named by their hash. A tile pair returns a count per node and a
spanning set of its links, never its pairs. Tiles are shipped as given and rotated where they are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, least_reached, scratch, stored

#: Vectors of a tile.
TILE = 512
#: Leading axes whose ranges bound a tile.
BOX = 8
_SUMS = 16


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _usable() -> F.Column:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good, F.lit(False))


def _axes(nodes: DataFrame, size: int) -> np.ndarray:
    """Principal axes of all unit vectors of that many components, one per row, widest first."""

    def gram(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            x /= np.linalg.norm(x, axis=1)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % _SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "gram"])

    def add(batches):
        total = np.zeros(size * size)
        for batch in batches:
            for raw in batch.column(1):
                total = total + np.frombuffer(raw.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "gram"])

    parts = nodes.where(F.size("embedding") == size).select("embedding").mapInArrow(gram, "part int, gram binary").repartition(_SUMS, "part").mapInArrow(add, "part int, gram binary").collect()
    total = sum((np.frombuffer(p.gram) for p in parts), np.zeros(size * size)).reshape(size, size)
    return np.linalg.eigh(total)[1].T[::-1]


def _turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the principal axes, or as they are where their length isn't that of the axes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    x = x / np.linalg.norm(x, axis=1)[:, None]
    return x @ axes.T if x.shape[1] == len(axes) else x


def _tiles(nodes: DataFrame, axes: np.ndarray, width: float) -> DataFrame:
    """tile, label, dim, c1, c2, low, high (boxes), and as binary the nodes, their counts and vectors."""

    def place(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _turned(_matrix(part.column("embedding")), axes)
                cell = [np.floor(x[:, i] / width).astype(np.int32) if i < dim else np.zeros(len(x), np.int32) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "copies", "label", "dim", "embedding")), pa.array(cell[0]), pa.array(cell[1]), pa.array(x[:, 2 if dim > 2 else 0])], ["node", "copies", "label", "dim", "embedding", "c1", "c2", "p"])

    def cut(batches):
        part, count = TaskContext.get().partitionId(), 0
        key, held = None, []

        def close():
            nonlocal count, held
            given = np.stack([h[2] for h in held])
            lead = _turned(given, axes)[:, :BOX]
            tile = pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | count], pa.int64()), pa.array([key[0]], pa.int64()), *(pa.array([k], pa.int32()) for k in key[1:]),
                    pa.array([lead.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([lead.max(axis=0).tolist()], pa.list_(pa.float64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), given)),
                ],
                ["tile", "label", "dim", "c1", "c2", "low", "high", "nodes", "copies", "given"],
            )
            count, held = count + 1, []
            return tile

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "dim", "c1", "c2", "node", "copies")]
            for i, vector in enumerate(batch.column("embedding")):
                now = tuple(c[i] for c in columns[:4])
                if held and (now != key or len(held) == TILE):
                    yield close()
                key = now
                held.append((columns[4][i], columns[5][i], np.asarray(vector.values)))
        if held:
            yield close()

    kind = dict(nodes.dtypes)["embedding"]
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.mapInArrow(place, f"node long, copies long, label long, dim int, embedding {kind}, c1 int, c2 int, p double")
    keys = ["label", "dim", "c1", "c2", "p", "node"]
    return placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(
        cut, "tile long, label long, dim int, c1 int, c2 int, low array<double>, high array<double>, nodes binary, copies binary, given binary"
    )


def compare(x: np.ndarray, y: np.ndarray, given_x: np.ndarray, given_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two tiles (rotated unit vectors, and the same as given) whose cosine reaches threshold."""
    size = x.shape[1]
    slack = np.float32(2e-7 * size + 1e-6)
    squares = [np.cumsum(v[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1] for v in (x, y)]
    rows, columns = np.arange(len(x)), np.arange(len(y))
    total = np.zeros((len(x), len(y)), np.float32)
    done, step = 0, min(8, size)
    while True:
        total += x[rows, done : done + step] @ y[columns, done : done + step].T
        done += step
        if done >= size:
            break
        rest_x, rest_y = (np.sqrt(np.maximum(s[i, done], 0)).astype(np.float32) for s, i in zip(squares, (rows, columns), strict=True))
        alive = total + rest_x[:, None] * rest_y[None, :] >= threshold - slack
        keep_x, keep_y = alive.any(axis=1), alive.any(axis=0)
        if not keep_x.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, columns = rows[keep_x], columns[keep_y]
        total = total[np.ix_(keep_x, keep_y)]
        step = min(done, size - done)
    i, j = np.nonzero(total >= threshold - slack)
    i, j = rows[i], columns[j]
    norm_x, norm_y = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (given_x, given_y))
    good = np.zeros(len(i), bool)
    for a in range(0, len(i), 16_384):
        p, q = i[a : a + 16_384], j[a : a + 16_384]
        good[a : a + 16_384] = np.einsum("ij,ij->i", given_x[p], given_y[q]) / (norm_x[p] * norm_y[q]) >= threshold
    return i[good], j[good]


def _linked(pairs: DataFrame, threshold: float, axes: np.ndarray, kind: type) -> DataFrame:
    """node, n (vectors linked with it), other (a node of the same component), over all tile pairs."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                one, dim = row["t1"].as_py() == row["t2"].as_py(), row["dim"].as_py()
                read = lambda c, kind: np.frombuffer(row[c].as_buffer(), kind)  # noqa: B023, E731
                nodes = [read(f"nodes{k}", np.int64) for k in (1, 2)]
                copies = [read(f"copies{k}", np.int64) for k in (1, 2)]
                given = [read(f"given{k}", kind).reshape(-1, dim).astype(np.float64) for k in (1, 2)]
                turned = [_turned(x, axes).astype(np.float32) for x in given]
                a, b = compare(*turned, *given, threshold)
                if one:
                    a, b = a[a < b], b[a < b]
                if not len(a):
                    continue
                names, at = np.unique(np.concatenate([nodes[0][a], nodes[1][b]]), return_inverse=True)
                at = at.reshape(2, -1)
                n = np.bincount(at[0], copies[1][b], len(names)) + np.bincount(at[1], copies[0][a], len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64)), pa.array(names[least_reached(len(names), *at)])], ["node", "n", "other"])

    return pairs.mapInArrow(run, "node long, n long, other long")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept (whether that is vec_id).

    Vectors link if their labels are equal and not null and their cosine is threshold or more. Null, zero or non-finite
    vectors, such with null components, vectors of different lengths and rows without a vec_id link with nothing: they
    are their own components. A repeated row is a vector of its own, and so are different vectors of one vec_id: each has
    its own links. Vectors that tie at the threshold link. An empty table gives no rows; other columns, whatever their names, are
    ignored. threshold: over 0.
    """
    from .components import components

    spark = embeddings.sparkSession
    base = scratch(spark, "embeddings")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.withColumn("ok", _usable()).withColumn("h1", F.when(F.col("ok"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding")))
    nodes = stored(
        rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("node", F.xxhash64("label", "h1", "h2")).withColumn("dim", F.size("embedding")),
        f"{base}/nodes",
    )
    common = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    axes = _axes(nodes, common.dim) if common else np.eye(1)
    kind = np.float32 if "float" in dict(nodes.dtypes)["embedding"] else np.float64
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * 1.001 + 1e-6
    tiles = stored(_tiles(nodes.select("node", "copies", "label", "dim", "embedding"), axes, width), f"{base}/tiles")
    # the same cell once, and half of those around it
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("d1"), F.lit(b).alias("d2")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    places = tiles.select("tile", "label", "dim", "c1", "c2", "low", "high")
    left = places.withColumn("d", around).withColumn("n1", F.col("c1") + F.col("d.d1")).withColumn("n2", F.col("c2") + F.col("d.d2")).alias("x")
    gaps = "aggregate(sequence(0, size(x.low) - 1), 0D, (s, i) -> s + power(greatest(0D, x.low[i] - y.high[i], y.low[i] - x.high[i]), 2))"
    pairs = left.join(
        places.alias("y"),
        F.expr(f"x.label = y.label and x.dim = y.dim and x.n1 = y.c1 and x.n2 = y.c2 and (x.d.d1 <> 0 or x.d.d2 <> 0 or x.tile <= y.tile) and {gaps} <= {width * width!r}"),
    ).select(F.col("x.tile").alias("t1"), F.col("y.tile").alias("t2"))
    pairs = stored(pairs, f"{base}/pairs")
    held = lambda k: tiles.select(F.col("tile").alias(f"t{k}"), *(["dim"] if k == 1 else []), *(F.col(c).alias(f"{c}{k}") for c in ("nodes", "copies", "given")))
    full = pairs.join(held(1), "t1").join(held(2), "t2")
    linked = stored(_linked(full, threshold, axes, kind), f"{base}/linked")
    counts = linked.groupBy("node").agg(F.sum("n").alias("n"))
    found = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b")))
    # components by their smallest vec_id
    named = found.join(nodes.select("node", "least"), "node")
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(smallest, "component").select("node", "smallest")
    result = nodes.select("label", "h1", "h2", "node", "copies", "least").join(counts, "node", "left").join(named, "node", "left")
    result = stored(result.select("label", "h1", "h2", "copies", "n", F.coalesce("smallest", "least").alias("component")), f"{base}/result")
    for name in ("nodes", "tiles", "pairs", "linked"):
        discard(spark, f"{base}/{name}")
    return (
        rows.select("vec_id", "label", "h1", "h2").join(result, ["label", "h1", "h2"], "left")
        .select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
