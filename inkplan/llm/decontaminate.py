"""Benchmark decontamination by spaced-seed hashing.

Each mask picks some words of a window and ignores the others, so a window with substitutions in the ignored places
hashes as the original does. Hashes of the benchmark's windows are joined with those of the documents' windows, of which
only such are shuffled as a filter of the benchmark's hashes lets through. That gives pairs of a text and an item with a
hash in common, whose texts are put together; around each hit, the item and the text are compared word by word along the
diagonal, and the best stretch (a match gains 1, a substitution costs 2) decides. If none of an item's diagonals in a text
does, those near each other are compared once more with words inserted or dropped, which cost 2 each. Words are runs of
letters and digits, in lower case.

Equal texts, and equal items, are one until the end. A text of many items is compared with so many at a time, so that no
task holds more; the benchmark never goes to the driver, and to the tasks only as a filter of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, IdFilter, Words, discard, fresh, giving_back, mixed, pieces, scratch, stored

#: 1: the word counts, 0: any word may stand there.
MASKS = ("11111", "1110111", "11011011", "1011001101")
#: Items that a text is compared with at once.
TOGETHER = 256
#: A stretch counts from so many equal words on, however long the item is (of an item no longer than that, from this part of it on,
#: and with one substitution from so many words on) ...
LEAST_MATCHES, LEAST_PART, ONE_OFF = 12, 0.85, 6
#: ... and if at least this part of its words is equal, or so many in a row are.
LEAST_EQUAL = 0.75
#: Words that a stretch may have inserted or dropped in all, at any one place, against the diagonal of a hit.
SHIFT = 4
#: Words on each side of a hit of which one more than the hit's own must be equal, if it takes more.
AROUND = 16
#: Items of fewer words are not looked for.
SHORTEST = 3
_ENTRIES = 500_000


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts), fold=False, separators=PUNCTUATION)


def _seeds(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each masked window inside a row, and the place of its first word."""
    n = len(words.hash) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, hash_of(mask), np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ words.hash[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
    at = np.flatnonzero(words.row[:n] == words.row[len(mask) - 1 :])
    return mixed(h[at]), at


def hash_of(mask: str) -> np.uint64:
    return np.uint64(int(mask, 2) * 64 + len(mask))


def _masks(lengths: np.ndarray, shortest: int) -> list[str]:
    """MASKS, and for items that are too short for one (or, with a substitution, may have none) masks of their whole length."""
    masks = list(MASKS)
    for n in sorted({int(n) for n in lengths if shortest <= n < max(map(len, MASKS))}):
        masks.append("1" * n)
        if ONE_OFF <= n < 8:
            masks += ["1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1)]
    return list(dict.fromkeys(masks))


def _item_seeds(words: Words, masks: list[str], shortest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per mask: hashes and places of the items' windows; a mask of a whole length takes items of that length alone."""
    lengths, out = np.diff(words.first), []
    for mask in masks:
        h, at = _seeds(words, mask)
        own = lengths[words.row[at]]
        fit = (own >= shortest) if mask in MASKS else (own == len(mask))
        out.append((h[fit], at[fit]))
    return out


class Benchmark:
    """Some items: their words, and the sorted hashes of their seeds."""

    def __init__(self, texts: list[str | None], shortest: int = SHORTEST):
        self.words = _words(pa.array(texts, pa.string()))
        self.lengths = np.diff(self.words.first)
        self.masks, self.tables = _masks(self.lengths, shortest), []
        for h, at in _item_seeds(self.words, self.masks, shortest):
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], at[order]))

    def find(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """The best stretch of each row and item that meets the limits."""
        words, found = _words(texts), []
        for mask, (known, places) in zip(self.masks, self.tables, strict=True):
            h, at = _seeds(words, mask)
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            hit = np.flatnonzero(high > low)
            h, at, low, many = h[hit], at[hit], low[hit], (high - low)[hit]
            # a seed that many items have is worked through in parts
            cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(many) - many) // _ENTRIES)) + 1).tolist(), len(h)] if len(h) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                which = np.repeat(np.arange(a, b), many[a:b])
                entry = np.arange(len(which)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + low[which]
                item = self.words.row[places[entry]]
                # the item's first word would stand here, counted in all words of the piece
                diagonal = at[which] - (places[entry] - self.words.first[item])
                own = np.stack([words.row[at[which]], item, diagonal], axis=1).astype(np.int64)
                found.append(_distinct(own[self._promising(words, own, at[which], mask)]))
        hits = _distinct(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)
        best = [self._stretch(words, hits[a : a + 20_000]) for a in range(0, len(hits), 20_000)]
        near = self._unsettled(hits, best)
        best += [self._shifted(words, near[a : a + 5_000]) for a in range(0, len(near), 5_000)]
        out = {k: np.concatenate([b[k] for b in best]) if best else np.zeros(0, np.int64) for k in ("row", "item", "start", "n_words", "n_equal")}
        # one stretch for each row and item: most equal words, then the first
        order = np.lexsort((out["start"], -out["n_equal"], out["item"], out["row"]))
        out = {k: v[order] for k, v in out.items()}
        new = np.ones(len(order), bool)
        new[1:] = (out["row"][1:] != out["row"][:-1]) | (out["item"][1:] != out["item"][:-1])
        return {k: v[new] for k, v in out.items()}

    def _promising(self, words: Words, hits: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
        """Whether more words are equal around a hit than it has itself, on any diagonal that a stretch may take, or these suffice."""
        row, item, diagonal = hits.T
        own, need = mask.count("1"), self._need(self.lengths[item])
        good = need <= own
        rest = np.flatnonzero(~good)
        low, high = words.first[row[rest]], words.first[row[rest] + 1]
        begin, past = self.words.first[item[rest]], self.words.first[item[rest] + 1]
        place = at[rest] - diagonal[rest] + begin
        skipped = [i for i, bit in enumerate(mask) if bit == "1"]
        more = np.zeros(len(rest), bool)
        for step in sorted(set(range(-AROUND, len(mask) + AROUND)) - set(skipped), key=lambda i: min(abs(i), abs(i - len(mask) + 1))):
            left = np.flatnonzero(~more)
            if not len(left):
                break
            there = place[left] + step
            inside = (there >= begin[left]) & (there < past[left])
            left, there = left[inside], there[inside]
            for shift in range(-SHIFT, SHIFT + 1):
                here = at[rest[left]] + step + shift
                ok = (here >= low[left]) & (here < high[left])
                # a word of the hit itself may not count for another of the item
                ok &= ~np.isin(step + shift, skipped)
                ok[ok] = words.hash[here[ok]] == self.words.hash[there[ok]]
                more[left[ok]] = True
        good[rest] = more
        return good

    def _stretch(self, words: Words, hits: np.ndarray) -> dict[str, np.ndarray]:
        """Along each diagonal the stretch of most equal words that meets the limits; of a short item also the whole of it."""
        row, item, diagonal = hits.T
        n = self.lengths[item]
        need = self._need(n)
        first, past = words.first[row], words.first[row + 1]
        zero = np.zeros(len(hits), np.int64)
        score, equal, begin, every, alike, longest, last = (zero.copy() for _ in range(7))
        start, size, matches = zero.copy(), zero.copy(), zero.copy()
        for i in range(int(n.max(initial=0))):
            at = diagonal + i
            inside = (i < n) & (at >= first) & (at < past)
            same = np.zeros(len(hits), bool)
            same[inside] = words.hash[at[inside]] == self.words.hash[self.words.first[item[inside]] + i]
            # a stretch begins with an equal word, and ends for good when it has lost more than one equal word brings
            fresh = (score < -1) | (equal == 0)
            begin = np.where(fresh, i, begin)
            equal = np.where(fresh, 0, equal) + same
            score = np.where(fresh, 0, score) + np.where(same, 1, -2)
            better = same & (equal >= need) & (equal >= LEAST_EQUAL * (i + 1 - begin)) & (equal > matches)
            start, size, matches = np.where(better, begin, start), np.where(better, i + 1 - begin, size), np.where(better, equal, matches)
            every += same
            alike = np.where(same, alike + 1, 0)
            longer = alike > longest
            longest, last = np.where(longer, alike, longest), np.where(longer, i, last)
        # the equal words in a row where no stretch has few enough substitutions, and short items as a whole
        run = (matches == 0) & (longest >= need) & (longest > 0)
        start, size, matches = np.where(run, last + 1 - longest, start), np.where(run, longest, size), np.where(run, longest, matches)
        whole = (n <= LEAST_MATCHES) & (every >= need) & (every > matches)
        start, size, matches = np.where(whole, 0, start), np.where(whole, n, size), np.where(whole, every, matches)
        good = matches > 0
        return {"row": row[good], "item": item[good], "start": np.maximum(0, diagonal + start - first)[good], "n_words": size[good], "n_equal": matches[good]}

    @staticmethod
    def _need(n: np.ndarray) -> np.ndarray:
        part = np.ceil(LEAST_PART * n).astype(np.int64)
        return np.where(n > LEAST_MATCHES, LEAST_MATCHES, np.where(n >= ONE_OFF, np.minimum(part, n - 1), part))

    @staticmethod
    def _unsettled(hits: np.ndarray, best: list[dict[str, np.ndarray]]) -> np.ndarray:
        """Hits of rows and items without a stretch, which have another hit of theirs within SHIFT diagonals."""
        if len(hits) < 2:
            return hits[:0]
        # hits are in order of row, item, diagonal
        pair = np.concatenate([[0], np.cumsum((hits[1:, :2] != hits[:-1, :2]).any(axis=1))])
        close = (pair[1:] == pair[:-1]) & (hits[1:, 2] - hits[:-1, 2] <= SHIFT)
        near = np.zeros(len(hits), bool)
        near[1:] |= close
        near[:-1] |= close
        names = hits[:, 0] << 32 | hits[:, 1]
        done = np.concatenate([b["row"] << 32 | b["item"] for b in best])
        return hits[near & ~np.isin(names, done)]

    def _shifted(self, words: Words, hits: np.ndarray) -> dict[str, np.ndarray]:
        """As _stretch, over the diagonals within SHIFT of each hit; the first stretch that meets the limits with the most equal words."""
        row, item, diagonal = hits.T
        n, need = self.lengths[item], self._need(self.lengths[item])
        first, past = words.first[row], words.first[row + 1]
        shifts = np.arange(-SHIFT, SHIFT + 1)
        # score, equal words, columns of the alignment, its first word in the document
        state = np.zeros((4, len(hits), len(shifts)), np.int64)
        found = np.zeros((3, len(hits)), np.int64)
        for i in range(int(n.max(initial=0))):
            at = diagonal[:, None] + i + shifts
            inside = (i < n)[:, None] & (at >= first[:, None]) & (at < past[:, None])
            own = self.words.hash[self.words.first[item] + np.minimum(i, n - 1)]
            same = inside & (words.hash[np.clip(at, 0, len(words.hash) - 1)] == own[:, None])
            # a word of the item dropped: the diagonal above, at the same word of the document
            dropped = np.zeros_like(state)
            dropped[:, :, :-1] = state[:, :, 1:]
            dropped[0] -= 2
            dropped[2] += 1
            fresh = state[0] <= 0
            state = np.where(fresh, np.stack([np.zeros_like(at), np.zeros_like(at), np.zeros_like(at), at]), state)
            state += np.stack([np.where(same, 1, -2), same, np.ones_like(at), np.zeros_like(at)])
            state = np.where(dropped[0] > state[0], dropped, state)
            # a word inserted: the diagonal below, at the same word of the item
            for s in range(1, len(shifts)):
                inserted = state[:, :, s - 1] + np.array([-2, 0, 1, 0])[:, None]
                state[:, :, s] = np.where(inserted[0] > state[0, :, s], inserted, state[:, :, s])
            good = same & (state[1] >= need[:, None]) & (state[1] >= LEAST_EQUAL * state[2])
            equal = np.where(good, state[1], 0)
            which = equal.argmax(axis=1)
            pick = np.arange(len(hits)), which
            better = equal[pick] > found[2]
            begin = state[3][pick]
            found = np.where(better, np.stack([begin - first, at[pick] + 1 - begin, equal[pick]]), found)
        good = found[2] > 0
        return {"row": row[good], "item": item[good], "start": found[0][good], "n_words": found[1][good], "n_equal": found[2][good]}


def _distinct(hits: np.ndarray) -> np.ndarray:
    """The distinct rows, in order."""
    hits = hits[np.lexsort(hits.T[::-1])]
    new = np.ones(len(hits), bool)
    new[1:] = (hits[1:] != hits[:-1]).any(axis=1)
    return hits[new]


def _text_name(text: str = "text") -> F.Column:
    return F.xxhash64(F.lit("text"), text)


def _seed_table(items: DataFrame, masks: list[str], shortest: int) -> DataFrame:
    """seed, item: the distinct hashes of each item (item, text)."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = _words(piece.column("text"))
                for h, at in _item_seeds(words, masks, shortest):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), piece.column("item").take(pa.array(words.row[at]))], ["seed", "item"])

    return items.mapInArrow(giving_back(run), "seed long, item long").distinct()


def _text_seeds(texts: DataFrame, masks: list[str], known: IdFilter) -> DataFrame:
    """seed, name: those hashes of each text (name, text) that the filter holds, each once for a row."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = _words(piece.column("text"))
                for mask in masks:
                    h, at = _seeds(words, mask)
                    hit = np.flatnonzero(known.holds(h.view(np.int64)))
                    if len(hit):
                        own = _distinct(np.stack([words.row[at[hit]], h[hit].view(np.int64)], axis=1))
                        yield pa.RecordBatch.from_arrays([pa.array(own[:, 1]), piece.column("name").take(pa.array(own[:, 0]))], ["seed", "name"])

    return texts.mapInArrow(giving_back(run), "seed long, name long")


def _lengths(items: DataFrame) -> np.ndarray:
    """The distinct numbers of words of items that are shorter than the longest mask: a handful."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                n = np.unique(np.diff(_words(piece.column("text")).first))
                yield pa.RecordBatch.from_arrays([pa.array(n[n < max(map(len, MASKS))], pa.int64())], ["n"])

    return np.array([r.n for r in items.select("text").mapInArrow(giving_back(run), "n long").distinct().collect()], np.int64)


def _found(documents: DataFrame, benchmark: DataFrame, base: str, shortest: int) -> DataFrame:
    """name (of the text), item, start, n_words, n_equal of each overlapping pair of different texts, kept below base."""
    items = stored(benchmark.where("text is not null").select(_text_name().alias("item"), "text").groupBy("item").agg(F.min("text").alias("text")), f"{base}/items")
    masks = _masks(_lengths(items), shortest)
    seeds = stored(_seed_table(items, masks, shortest), f"{base}/seeds")
    texts = documents.where("text is not null").select(_text_name().alias("name"), "text")
    known = IdFilter(seeds, "seed", seeds.count(), spare=16)
    pairs = stored(_text_seeds(texts, masks, known).distinct().join(seeds, "seed").select("name", "item").distinct(), f"{base}/pairs")
    # a text's items in parts of about TOGETHER; a hot text is one row for each part
    parts = pairs.groupBy("name").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    wanted = IdFilter(parts, "name", parts.count())

    def likely(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted.holds(np.asarray(batch.column("name"), np.int64))))

    some = texts.mapInArrow(giving_back(likely), "name long, text string").join(parts.select("name"), "name", "left_semi").groupBy("name").agg(F.min("text").alias("text"))
    grouped = pairs.join(parts, "name").join(items.withColumnRenamed("text", "item_text"), "item").groupBy("name", F.pmod("item", "parts").alias("part")).agg(F.collect_list(F.struct("item", "item_text")).alias("items"))

    def verify(batches):
        for batch in batches:
            for i in range(len(batch)):
                own = batch.column("items")[i].as_py()
                hits = Benchmark([x["item_text"] for x in own], shortest).find(batch.column("text").slice(i, 1))
                if len(hits["row"]):
                    item = np.array([x["item"] for x in own], np.int64)[hits["item"]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("name")[i].as_py(), len(item)), pa.int64()), pa.array(item), *(pa.array(hits[k], pa.int64()) for k in ("start", "n_words", "n_equal"))], ["name", "item", "start", "n_words", "n_equal"])

    found = grouped.join(some, "name").select("name", "items", "text").mapInArrow(giving_back(verify), "name long, item long, start long, n_words long, n_equal long")
    return stored(found, f"{base}/found")


def overlaps(documents: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, start (word of the document), n_words and n_equal of the best stretch of each overlapping pair.

    A pair overlaps from LEAST_MATCHES equal words on, of which one in four may be substituted, or SHIFT inserted or dropped;
    items of fewer words with one substitution from ONE_OFF words on, else whole. Null and empty texts overlap with nothing, items of
    fewer words than shortest neither; rows with a null id keep it. Repeated rows, of either table, give repeated results.
    Of stretches that tie the first counts. Texts are read whole, however long. An empty table of either kind gives no
    rows; other columns, whatever their names, are ignored.
    """
    base = scratch(documents.sparkSession, "overlaps")
    found = _found(documents, benchmark, base, shortest)
    own = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _text_name().alias("name"))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), _text_name().alias("item"))
    out = stored(own.join(found.join(items, "item"), "name").select("doc_id", "item_id", "start", "n_words", "n_equal"), f"{base}/overlaps")
    for name in ("items", "seeds", "pairs", "found"):
        discard(documents.sparkSession, f"{base}/{name}")
    return out


def without_overlaps(documents: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The documents, with all their columns, whatever their names, that overlap with no item.

    Rows with a null text or doc_id are judged by their text like others. Texts are shuffled only if the table of those that overlap is
    too large for Spark to broadcast.
    """
    base = scratch(documents.sparkSession, "overlaps")
    found = stored(_found(documents, benchmark, base, shortest).select("name").distinct(), f"{base}/names")
    for name in ("items", "seeds", "pairs", "found"):
        discard(documents.sparkSession, f"{base}/{name}")
    c = fresh(documents, "name")
    return documents.withColumn(c, F.coalesce(F.when(F.col("text").isNotNull(), _text_name()), F.lit(0).cast("long"))).join(found.withColumnRenamed("name", c), c, "left_anti").select(*documents.columns)
