"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles. All sets are ordered alike: by a fixed-size sketch of how often
each shingle occurs over all documents, rare ones first, then by hash. The larger the input, the more of what the sketch
takes for rare isn't: prefixes are made a first time to find the shingles that stand in several of them, and made again
with those behind all others. That too is one order for all sets. Two sets of similarity t or more share at least
l shingles among their first n - ceil(t n) + l ones, for every l. Each document picks its own l: the one for which the
estimated cost of its candidates (postings of the prefix by the sketch, and the sets that those left by l matches have
to read) is least.
A pair is held to the smaller l of the two, so both prefixes hold what that l needs, and candidates are verified exactly.

Equal sets are one node throughout, so thousands of copies cost as much as one document. Groups of near copies share
many prefix shingles and would pair all their members. They are settled first: at each shingle of several prefixes the
set that has most such shingles (of near copies, the one they all derive from, if it is there) is the pivot; each set is
verified against one pivot of its own, and what links is one class. From then on only pairs of different classes are
candidates. Shingles that still stand in the prefixes of many sets of several classes are left out of the join, where a
pair then has to share l shingles less those left out. Sets of which so many are left out that a pair may share no other
go to tiles, each to one of its pivot and class, and two tiles with such a shingle in common are compared once by a product of
incidence matrices, which returns a spanning set of the links between classes and no pairs. This loses nothing: a pair
shares at least one shingle of the prefixes for l = 1; if it shares more of its l than were left out of either set, it is
joined, and if not, the set that asks for fewer has l left out and the other one too, so that both are in tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, Words, discard, fresh, giving_back, least_reached, mixed, pieces, scratch, shingles, stored

#: Counters of the frequency sketch: 4 MB, whatever the input's size.
SKETCH_BITS = 20
_SLICES = 16
#: Largest number of matches that a document may ask for.
MOST_MATCHES = 16
#: Sets with the same shingle in their prefixes, from which on they have a pivot, and from which on they are compared in tiles.
SEVERAL, COMMON = 8, 64
#: Sets that are verified against one copy of their pivot's set.
STAR = 512
#: Sets of a tile, and bytes of it.
TILE, TILE_BYTES = 1024, 8 << 20
#: Other documents that are expected at a shingle whose count doesn't stand out from the sketch's noise.
UNSEEN = 0.5
#: Bytes of tiles that are laid side by side at once; more of them, up to twice what all tiles weigh, where these are more.
LAID_BYTES = 1 << 30


def _name(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set of distinct hashes; the first one is its node."""
    m = mixed(own)
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(mixed(m).sum(dtype=np.uint64).view(np.int64))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often each slot's shingles occur over all documents (a text's repeats of a shingle count each time)."""
    width = 1 << SKETCH_BITS

    def count(batches):
        total = np.zeros(width, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, _ = shingles(Words(piece.column("text")), k)
                total += np.bincount(_slot(h), minlength=width)
        if total.any():
            parts = total.astype(np.int32).reshape(_SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.int32)
                sums[s] = sums[s] + part if s in sums else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    parts = docs.select("text").mapInArrow(giving_back(count), "slice int, counts binary").repartition(_SLICES, "slice").mapInArrow(giving_back(add), "slice int, counts binary").collect()
    out = np.zeros((_SLICES, width // _SLICES), np.float32)
    for s, raw in parts:
        out[s] += np.frombuffer(raw, np.float32)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, sketch: np.ndarray, crowded: IdFilter | None = None) -> DataFrame:
    """Per document: n (set size), two longs that name the set, l, and its prefix in order (level i at place n - ceil(t n) + i).

    Shingles that crowded holds, by their names in prefixes made without it, come behind all others.
    """
    load = np.float32(sketch.mean())
    spread = np.float32(max(1.0, np.sqrt(load)))
    # levels of frequency: nothing beyond the sketch's own noise is level 0, then powers of two
    level = np.clip(np.ceil(np.log2(np.maximum(1, (sketch - load) / (4 * spread)))), 0, 127).astype(np.uint64)
    excess = np.maximum(0, sketch - load - 4 * spread)

    def prefixes(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, row = shingles(Words(piece.column("text")), k)
                first = np.searchsorted(row, np.arange(len(piece) + 1))
                sets = [np.unique(h[first[i] : first[i + 1]]) for i in range(len(piece))]
                sizes, names, wanted, heads = [len(own) for own in sets], [], [], []
                past = np.cumsum(sizes)
                every = np.concatenate([np.zeros(0, np.uint64), *sets])
                slot = _slot(every)
                keys = (level[slot] << np.uint64(56)) | (every & np.uint64((1 << 56) - 1))
                others = excess[slot]
                if crowded is not None:
                    hit = crowded.holds(keys.view(np.int64))
                    keys[hit] |= np.uint64(1 << 63)
                    others[hit] = np.maximum(others[hit], SEVERAL)
                for own, n, end in zip(sets, sizes, past.tolist(), strict=True):
                    if not n:
                        names.append((0, 0))
                        wanted.append(0)
                        heads.append([])
                        continue
                    names.append(_name(own))
                    ranks = keys[end - n : end]
                    base = n - -(-num * n // den)
                    most = min(MOST_MATCHES, n - base)
                    order = np.argsort(ranks)[: base + most]
                    # postings read, and candidates left (fewer with the square of the matches asked for) that each read a set
                    postings = np.cumsum(others[end - n : end][order] + UNSEEN)[base:]
                    asked = np.arange(1, most + 1)
                    pick = int(np.argmin(asked + postings + n / 2 * postings / asked**2)) + 1
                    wanted.append(pick)
                    heads.append(ranks[order[: base + pick]].view(np.int64))
                lengths = np.array([len(x) for x in heads], np.int64)
                flat = np.concatenate([np.asarray(x, np.int64) for x in heads]) if len(heads) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array(wanted, pa.int32()), lists],
                    ["doc_id", "n", "node", "check", "l", "head"],
                )

    return docs.mapInArrow(giving_back(prefixes), "doc_id long, n long, node long, check long, l int, head array<long>")


def _names(heads: DataFrame) -> DataFrame:
    """One row for equal sets: n, node, check, rep (the smallest doc_id), l, head. Their copies are merged before anything is shuffled."""
    return heads.where("n > 0 and doc_id is not null").groupBy("n", "node", "check").agg(F.min("doc_id").alias("rep"), F.first("l").alias("l"), F.first("head").alias("head"))


def _counted(names: DataFrame) -> DataFrame:
    """token, sets: the shingles in more than one prefix."""
    return names.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")


def _of_wanted(docs: DataFrame, k: int, wanted: DataFrame, kept) -> DataFrame:
    """node, n and kept(its sorted hashes) of the wanted nodes (node, rep); one row per node.

    Only texts of wanted doc_ids (and a few more, see IdFilter) are cut into shingles.
    """
    ids = IdFilter(wanted, "rep", wanted.count())

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(ids.holds(np.asarray(batch.column("doc_id"), np.int64))))
            for piece in pieces(batch, "text"):
                h, row = shingles(Words(piece.column("text")), k)
                first = np.searchsorted(row, np.arange(len(piece) + 1))
                own = [np.unique(h[first[i] : first[i + 1]]) for i in range(len(piece))]
                yield pa.RecordBatch.from_arrays([pa.array([_name(x)[0] for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([kept(x).tobytes() for x in own], pa.binary())], ["node", "n", "kept"])

    found = docs.where("doc_id is not null").mapInArrow(giving_back(sets), "node long, n long, kept binary").join(wanted.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.min("n").alias("n"), F.min("kept").alias("kept"))


def _sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """node, n and the whole sorted sets, as little-endian 64-bit hashes."""
    return _of_wanted(docs, k, wanted, lambda own: own).withColumnRenamed("kept", "hashes")


def tally(own: np.ndarray) -> np.ndarray:
    """How many hashes lie in each of equal parts of their range, 255 for more; parts are a power of two and hold about three hashes each."""
    bits = max(2, (len(own) // 4).bit_length())
    return np.minimum(np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two sets with these tallies can share at most; a part of 255 or more bounds nothing."""
    x, y = (np.where(v == 255, 1 << 40, v.astype(np.int64)) for v in (x, y))
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(axis=1)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(axis=1)
    return int(np.minimum(x, y).sum())


def _likely(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose tallies allow the similarity."""

    def run(batches):
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (m, n, x, y) in enumerate(zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True)):
                most = most_shared(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                good[i] = den * most >= num * (m + n - most)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

    return pairs.mapInArrow(giving_back(run), "a long, b long")


def _verified(pairs: DataFrame, num: int, den: int) -> DataFrame:
    def verify(batches):
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("ha"), batch.column("hb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = den * shared >= num * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

    return pairs.mapInArrow(giving_back(verify), "a long, b long")


def _postings(names: DataFrame, kept: IdFilter) -> DataFrame:
    """token, node, n, l, place, score (how many of its set's) of the prefix shingles that the filter holds."""

    def run(batches):
        for batch in batches:
            heads = batch.column("head")
            token = np.asarray(heads.flatten(), np.int64)
            lengths = np.asarray(pa.compute.list_value_length(heads), np.int64)
            row = np.repeat(np.arange(len(batch)), lengths)
            place = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            hit = kept.holds(token)
            own = row[hit]
            score = np.bincount(own, minlength=len(batch))[own]
            yield pa.RecordBatch.from_arrays([pa.array(token[hit]), *(batch.column(c).take(pa.array(own)) for c in ("node", "n", "l")), pa.array(place[hit]), pa.array(score)], ["token", "node", "n", "l", "place", "score"])

    return names.select("node", "n", "l", "head").mapInArrow(giving_back(run), "token long, node long, n long, l int, place long, score long")


def _stars(posts: DataFrame, num: int, den: int) -> DataFrame:
    """node, pivot, salt: each set with the pivot that it shares most shingles with, if these are as many as either asks for.

    No more than about STAR sets have the same pivot and salt.
    """
    chosen = posts.groupBy("token").agg(F.max(F.struct("score", "node", "n", "l")).alias("p")).select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.l").alias("pivot_l"))
    met = posts.join(chosen, "token").where(f"node <> pivot and {num} * n <= {den} * pivot_n and {num} * pivot_n <= {den} * n")
    met = met.groupBy("node", "pivot").agg(F.count("*").alias("times"), F.min(F.least("l", "pivot_l")).alias("asked")).where("times >= asked")
    best = met.groupBy("node").agg(F.max_by("pivot", F.struct("times", "pivot")).alias("pivot"))
    many = best.groupBy("pivot").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    return best.join(many, "pivot").select("node", "pivot", F.pmod("node", "parts").alias("salt"), "parts")


def _star_links(stars: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The stars' links that hold. A pivot's set goes to each part of its sets, so none of them meets more than STAR."""
    own = stars.join(sets, "node").select(F.col("node").alias("a"), F.col("hashes").alias("ha"), "pivot", "salt")
    pivots = stars.groupBy("pivot").agg(F.max("parts").alias("parts")).select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
    pivots = pivots.join(sets.select(F.col("node").alias("pivot"), F.col("hashes").alias("hb")), "pivot")
    return _verified(own.join(pivots, ["pivot", "salt"]).select("a", F.col("pivot").alias("b"), "ha", "hb"), num, den)


def _tiles(rows: DataFrame) -> DataFrame:
    """rows: block, label, n, node, hashes. Tiles of sets of one block, label by label and size by size: tile, docs, labels, sizes, hashes."""

    def cut(batches):
        part, count, key, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def close():
            nonlocal count, held, size
            columns = [np.array([h[c] for h in held], np.int64).tobytes() for c in range(3)]
            out = pa.RecordBatch.from_arrays([pa.array([part << 32 | count], pa.int64()), *(pa.array([x], pa.binary()) for x in (*columns, b"".join(h[3] for h in held)))], ["tile", "docs", "labels", "sizes", "hashes"])
            count, held, size = count + 1, [], 0
            return out

        for batch in batches:
            for block, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "label", "n", "hashes")), strict=True):
                if held and (block != key or len(held) == TILE or size + len(row[3]) > TILE_BYTES):
                    yield close()
                key, size = block, size + len(row[3])
                held.append(row)
        if held:
            yield close()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["block", "label", "n", "node"]
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(giving_back(cut), "tile long, docs binary, labels binary, sizes binary, hashes binary")


def _tile_members(tiles: DataFrame) -> DataFrame:
    """tile, node, label, n of every set in a tile."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                columns = [pa.array(np.frombuffer(batch.column(c)[i].as_buffer(), np.int64)) for c in ("docs", "labels", "sizes")]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("tile")[i].as_py(), len(columns[0]))), *columns], ["tile", "node", "label", "n"])

    return tiles.select("tile", "docs", "labels", "sizes").mapInArrow(giving_back(run), "tile long, node long, label long, n long")


def shared_counts(sizes: list[np.ndarray], hashes: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of one tile has in common with each set of the other."""
    names = np.unique(hashes[0])
    names = names[np.isin(names, hashes[1])]
    total = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    at, row = [], []
    for n, h in zip(sizes, hashes, strict=True):
        i = np.searchsorted(names, h)
        i[i == len(names)] = 0
        hit = names[i] == h if len(names) else np.zeros(len(h), bool)
        at.append(i[hit])
        row.append(np.repeat(np.arange(len(n)), n)[hit])
    for a in range(0, len(names), 4096):
        matrix = []
        for i, r, n in zip(at, row, sizes, strict=True):
            own = (i >= a) & (i < a + 4096)
            m = np.zeros((len(n), min(4096, len(names) - a)), np.float32)
            m[r[own], i[own] - a] = 1
            matrix.append(m)
        total += matrix[0] @ matrix[1].T
    return total


def _linked(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning links between the labels of each pair of tiles: one row at most for each label that isn't the least of its links."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                labels, sizes, hashes = [[read(f"{c}{k}", kind) for k in (1, 2)] for c, kind in (("labels", np.int64), ("sizes", np.int64), ("hashes", np.uint64))]
                both = shared_counts(sizes, hashes).astype(np.int64)
                a, b = np.nonzero((den * both >= num * (sizes[0][:, None] + sizes[1][None, :] - both)) & (labels[0][:, None] != labels[1][None, :]))
                if len(a):
                    names, at = np.unique(np.concatenate([labels[0][a], labels[1][b]]), return_inverse=True)
                    low = names[least_reached(len(names), *at.reshape(2, -1))]
                    other = names != low
                    yield pa.RecordBatch.from_arrays([pa.array(low[other]), pa.array(names[other])], ["a", "b"])

    return pairs.mapInArrow(giving_back(run), "a long, b long")


def _spans(met: DataFrame, tiles: DataFrame, num: int, den: int, uri: str, laid: int = LAID_BYTES) -> DataFrame:
    """_linked() of the pairs of tiles in met, stored. Each pair is a copy of two tiles: these are laid out and compared in rounds, so disk doesn't grow with the pairs."""
    held = lambda i: tiles.select(*(F.col(c).alias(f"{c}{i}") for c in ("tile", "labels", "sizes", "hashes")))
    weigh = lambda i: tiles.select(F.col("tile").alias(f"tile{i}"), F.length("hashes").alias(f"bytes{i}"))
    copied = met.join(weigh(1), "tile1").join(weigh(2), "tile2").agg(F.sum(F.col("bytes1") + F.col("bytes2"))).first()[0] or 0
    all_tiles = tiles.agg(F.sum(F.length("hashes"))).first()[0] or 0
    rounds = max(1, -(-copied // max(laid, 2 * all_tiles)))
    out = []
    for i in range(rounds):
        own = met.where(F.pmod(F.xxhash64("tile1", "tile2"), F.lit(rounds)) == i)
        out.append(stored(_linked(own.join(held(1), "tile1").join(held(2), "tile2"), num, den).distinct(), f"{uri}/{i}"))
    spark = tiles.sparkSession
    return spark.read.schema(out[0].schema).parquet(*(f"{uri}/{i}" for i in range(rounds)))


def _met(members: DataFrame, open_tokens: DataFrame, num: int, den: int) -> DataFrame:
    """tile1, tile2: the pairs of tiles that have a shingle in common, for sets of different labels and of sizes that may link."""
    spread = lambda c: (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))
    per = open_tokens.join(members, "node").groupBy("token", "tile").agg(*spread("n"), *spread("label"))
    p, q = per.alias("p"), per.alias("q")
    return p.join(
        q,
        F.expr(
            f"p.token = q.token and p.tile <= q.tile and {num} * p.low_n <= {den} * q.high_n and {num} * q.low_n <= {den} * p.high_n"
            " and not (p.low_label = p.high_label and q.low_label = q.high_label and p.low_label = q.low_label)"
        ),
    ).select(F.col("p.tile").alias("tile1"), F.col("q.tile").alias("tile2")).distinct()


def jaccard_links(documents: DataFrame, k: int = 5, num: int = 8, den: int = 10, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """Documents with their sets, and links that connect all sets which links of similarity num / den or more connect.

    documents: doc_id long and text, other columns ignored, whatever their names. Returns (members, links). members:
    doc_id, n, node (its set's name) and rep - the smallest doc_id with the same set; both are null where the set is empty
    or doc_id is null. links: (a, b), nodes: a spanning set of all linked pairs.
    """
    from .components import components

    spark = documents.sparkSession
    base = scratch(spark, "jaccard")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = _sketch(docs, k)
    heads = stored(_prefixes(docs, k, num, den, sketch), f"{base}/first")
    # what stands in several prefixes, rare as the sketch may find it, makes way for other shingles
    several = stored(_counted(_names(heads)).where(F.col("sets") >= min(SEVERAL, common)), f"{base}/several")
    if count := several.count():
        crowded = IdFilter(several, "token", count)
        discard(spark, f"{base}/first")
        heads = stored(_prefixes(docs, k, num, den, sketch, crowded), f"{base}/heads")
    names = stored(_names(heads), f"{base}/names")
    members = heads.select("doc_id", "n", "node", "check").join(names.select("n", "node", "check", "rep"), ["n", "node", "check"], "left")
    known = F.col("rep").isNotNull() & F.col("doc_id").isNotNull()
    members = stored(members.select("doc_id", "n", F.when(known, F.col("node")).alias("node"), F.when(known, F.col("rep")).alias("rep")), f"{base}/members")
    for name in ("first", "several", "heads"):
        discard(spark, f"{base}/{name}")
    reps = names.select("node", "rep")
    counted = stored(_counted(names), f"{base}/counted")

    # near copies are settled against pivots
    several = counted.where(F.col("sets") >= min(SEVERAL, common))
    posts = stored(_postings(names, IdFilter(several, "token", several.count())).join(several, "token"), f"{base}/posts")
    first = f"n - (({num} * n + {den - 1}) div {den})"
    stars = stored(_stars(posts, num, den), f"{base}/stars")
    wanted = stars.select("node").unionByName(stars.select(F.col("pivot").alias("node"))).distinct()
    sets = stored(_sets(docs, k, stored(reps.join(wanted, "node"), f"{base}/wanted")), f"{base}/sets")
    near = stored(_star_links(stars, sets, num, den), f"{base}/near")
    labels = stored(components(near).select("node", F.col("component").alias("label")), f"{base}/labels")

    # common shingles of several classes are left out of the join; sets that may share no other are to be compared in tiles
    crowded = posts.where(F.col("sets") >= common).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    still = crowded.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("token")
    crowded = stored(crowded.join(still, "token", "left_semi").selectExpr("node", "n", "l", "token", "label", f"place <= {first} as leads"), f"{base}/crowded")
    left_out = stored(crowded.groupBy("node").agg(F.count("*").alias("out")), f"{base}/out")
    lead = crowded.where("leads").join(left_out, "node")
    asked_least = lead.where("out >= l").groupBy("token").agg(F.min("l").alias("least"))
    lead = stored(lead.join(asked_least, "token").where("out >= least").select("token", "node", "n", "label"), f"{base}/lead")

    # the others are joined; shingles in one prefix alone match nothing: most rows go before the shuffle
    shared = counted.where(F.col("sets") < common)
    tokens = _postings(names, IdFilter(shared, "token", shared.count())).join(counted.where(F.col("sets") >= common), "token", "left_anti")
    tokens = tokens.select("token", "node", "n", (F.col("place") * 32 + F.col("l")).alias("at"))
    x, y = tokens.alias("x"), tokens.alias("y")
    # misses that a pair of these sizes may have at most: n + n' - 2 ceil(t (n + n') / (1 + t))
    spare = f"(x.n + y.n - 2 * (({num} * (x.n + y.n) + {num + den - 1}) div {num + den}))"
    place = lambda r: f"shiftright({r}.at, 5)"
    asked = "least(x.at & 31, y.at & 31)"
    # the least l whose prefix holds a place
    level = lambda r: f"({place(r)} + 1 - ({first.replace('n ', f'{r}.n ').replace(' n', f' {r}.n')}))"
    pairs = (
        x.join(
            y,
            F.expr(
                f"x.token = y.token and x.node < y.node and {num} * x.n <= {den} * y.n and {num} * y.n <= {den} * x.n"
                f" and greatest({level('x')}, {level('y')}) <= {asked} and {place('x')} + {place('y')} + 2 <= {spare} + 2 * {asked}"
            ),
        )
        .groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .agg(F.sort_array(F.collect_list(F.expr(f"{place('x')} + {place('y')}"))).alias("places"), F.min(F.expr(asked)).alias("asked"), F.min(F.expr(spare)).alias("spare"))
    )
    for side in ("a", "b"):
        pairs = pairs.join(left_out.select(F.col("node").alias(side), F.col("out").alias(f"out_{side}")), side, "left")
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    pairs = pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    pairs = pairs.withColumn("out", F.least(F.coalesce("out_a", F.lit(0)), F.coalesce("out_b", F.lit(0))))
    # before its k-th common shingle a linked pair has passed no more other ones than it may miss
    pairs = pairs.where("size(places) >= asked - out and forall(transform(places, (p, i) -> p - 2 * i), m -> m <= spare + 2 * out)").select("a", "b")
    # pairs that meet in a tile are compared there
    met = lead.groupBy("node").agg(F.collect_list("token").alias("tokens"))
    for side in ("a", "b"):
        pairs = pairs.join(met.select(F.col("node").alias(side), F.col("tokens").alias(f"t{side}")), side, "left")
    pairs = stored(pairs.where(~F.coalesce(F.arrays_overlap("ta", "tb"), F.lit(False))).select("a", "b"), f"{base}/candidates")

    # most candidates fall on a small part of what their sets weigh
    both = lambda: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    short = stored(_of_wanted(docs, k, stored(reps.join(both().distinct(), "node"), f"{base}/either"), tally), f"{base}/short")
    for side in ("a", "b"):
        pairs = pairs.join(short.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("kept").alias(f"s{side}")), side)
    pairs = stored(_likely(pairs, num, den), f"{base}/pairs")

    wanted = both().unionByName(lead.select("node")).distinct().join(sets.select("node"), "node", "left_anti")
    sets = sets.unionByName(stored(_sets(docs, k, stored(reps.join(wanted, "node"), f"{base}/wanted2")), f"{base}/sets2"))
    rows = lead.select("node", "n", "label").distinct().join(stars.select("node", "pivot"), "node", "left").select("node", "n", "label", F.coalesce("pivot", "node").alias("block"))
    tiles = stored(_tiles(rows.join(sets.select("node", "hashes"), "node")), f"{base}/tiles")
    met = stored(_met(_tile_members(tiles), lead.select("token", "node"), num, den), f"{base}/met")
    spans = _spans(met, tiles, num, den, f"{base}/spans")

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    links = _verified(full, num, den).unionByName(spans).unionByName(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    # rows of one doc_id and different texts are one document: its sets belong together
    same = members.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").join(members.select("doc_id", F.col("node").alias("b")), "doc_id").where("a <> b").select("a", "b")
    links = stored(links.unionByName(same), f"{base}/links")
    for name in ("names", "counted", "posts", "stars", "wanted", "sets", "near", "labels", "crowded", "out", "lead", "either", "wanted2", "sets2", "tiles", "met", "spans", "candidates", "short", "pairs"):
        discard(spark, f"{base}/{name}")
    return members, links


def jaccard_classes(documents: DataFrame, k: int = 5, num: int = 8, den: int = 10, common: int = COMMON) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null or empty text: n_shingles 0, its own component. Null doc_id: component_id null. Rows that repeat a doc_id are
    one document and share a component; where their texts differ, it is linked with whatever any of them links to, and
    each row has its own text's n_shingles. Texts are used whole, however long; case is folded for A-Z only. An empty
    table gives no rows. Columns other than doc_id and text are not looked at, whatever their names.
    """
    from .components import components

    members, links = jaccard_links(documents, k, num, den, common)
    found = components(links)
    # the smallest doc_id of each component of several nodes
    least = members.join(found, "node").groupBy("component").agg(F.min("rep").alias("least"))
    joined = members.join(found.join(least, "component").select("node", "least"), "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "rep", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The documents, with all their columns, without those that link to one of a smaller doc_id.

    Of rows that repeat doc_id and text one stays; rows with a null doc_id stay. Only rows of repeated ids are compared
    by their texts. Columns may have any names.
    """
    ids = jaccard_classes(documents.select("doc_id", "text"), k, num, den).where("doc_id is not null").groupBy("doc_id")
    marks = ids.agg(F.count("*").alias("rows"), F.min("component_id").alias("least")).where("rows > 1 or least < doc_id")
    mark, again = fresh(documents, "mark"), F.lit(1)
    marks = stored(marks.select(F.col("doc_id").alias(f"{mark}_id"), F.when(F.col("least") == F.col("doc_id"), again).otherwise(0).alias(mark)), scratch(documents.sparkSession, "copies"))
    joined = documents.join(marks, documents["doc_id"].cast("long") == F.col(f"{mark}_id"), "left")
    once = joined.where(F.col(mark).isNull()).select(*(documents[c] for c in documents.columns))
    several = joined.where(F.col(mark) == again).select(*(documents[c] for c in documents.columns))
    return once.unionByName(several.dropDuplicates(["doc_id", "text"]))
