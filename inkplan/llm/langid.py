"""Language identification: script ranges narrow the candidates of each word, per-word trigram scores feed a Viterbi
search with a switching penalty, and its path labels spans of mixed-language text.

All of a batch's texts are one array of code points; hashing, scoring and the search run on whole arrays. The search
steps through word places, all texts at once, so its loop is as long as the longest text of the piece.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, pieces

#: Hash slots of the trigram table of each language.
SLOTS = 1 << 16
#: At most about so many documents of each language are fitted on: those of the least hash of doc_id.
FIT_DOCUMENTS = 5_000
#: Cost of a change of language between two words, in nats.
SWITCH = 8.0
#: Text bytes that are scored at once, for so many languages; fewer for more of them.
SCORED_BYTES, SCORED_LANGUAGES = 1 << 20, 16
_SMOOTH = 0.5
_NEVER = np.float32(-1e9)

#: First and last code point of script ranges, as the Unicode standard gives them.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("latin", 0xFF21, 0xFF5A), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
]
_NAMES = ["other", *dict.fromkeys(s[0] for s in SCRIPTS)]
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: 1 for a letter, 2 for a mark, which belongs to the letter before it, else 0; and its script's number."""
    if not _TABLES:
        kinds = np.array(["LM".find(unicodedata.category(chr(c))[0]) + 1 for c in range(sys.maxunicode + 1)], np.uint8)
        script = np.zeros(sys.maxunicode + 1, np.uint8)
        for name, a, b in SCRIPTS:
            script[a : b + 1] = _NAMES.index(name)
        _TABLES.extend([kinds, script])
    return _TABLES[0], _TABLES[1]


class Grams:
    """Words of texts (runs of letters, lower case) with the trigram slots of each."""

    def __init__(self, texts: list[str | None]):
        letter, script = _tables()
        lowered = [(t or "").lower() for t in texts]
        lengths = np.array([len(t) for t in lowered], np.int64)
        code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letter[code]
        # marks are part of a word where a letter, or marks alone after one, stand before them
        last = np.maximum.accumulate(np.where(kind != 2, np.arange(len(kind), dtype=np.int32), np.int32(0)))
        solid = kind[last] == 1
        code = np.where(solid, code, np.uint32(0))
        del kind, last, solid
        before = np.concatenate([np.zeros(1, np.uint32), code[:-1]])
        earlier = np.concatenate([np.zeros(1, np.uint32), before[:-1]])
        earlier[before == 0] = 0
        with np.errstate(over="ignore"):
            mix = earlier * np.uint32(0x9E3779B1) ^ before * np.uint32(0x85EBCA77) ^ code * np.uint32(0xC2B2AE3D)
            mix = (mix ^ (mix >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        slots = (mix >> np.uint32(16)).astype(np.int32)
        # a word's trigrams are at its letters and at the place after it
        live = (code != 0) | (before != 0)
        head = (code != 0) & (before == 0)
        starts = np.flatnonzero(head)
        self.slots = slots[live]
        self.begins = np.flatnonzero(head[live])
        self.letters = np.diff(np.concatenate([self.begins, [len(self.slots)]])) - 1
        ends = np.cumsum(lengths + 1)
        self.row = np.searchsorted(ends, starts, side="right")
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))
        # the script of a word is that of its first letter
        self.script = script[code[starts]]


def _counts(labelled: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Per language: occurrences of each trigram slot, then words of each script. One value of fixed size for each language."""
    width = SLOTS + len(_NAMES)

    def out(langs: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in langs.values()], pa.binary())], ["lang", "counts"])

    def count(batches):
        langs: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text", SCORED_BYTES):
                grams, names = Grams(piece.column("text").to_pylist()), np.array(piece.column("lang").to_pylist(), object)
                word_lang = names[grams.row]
                for lang in set(names.tolist()):
                    own = word_lang == lang
                    spread = np.repeat(own, grams.letters + 1)
                    langs[lang] = langs.get(lang, 0) + np.concatenate([np.bincount(grams.slots[spread], minlength=SLOTS), np.bincount(grams.script[own], minlength=len(_NAMES))])
            if len(langs) > 64:
                yield out(langs)
                langs = {}
        yield out(langs)

    def add(batches):
        langs: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                langs[lang] = langs.get(lang, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        yield out(langs)

    schema = "lang string, counts binary"
    found = labelled.select("text", "lang").mapInArrow(giving_back(count), schema).repartition("lang").mapInArrow(giving_back(add), schema).collect()
    assert all(len(r.counts) == 8 * width for r in found)
    return [(r.lang, np.frombuffer(r.counts, np.int64)) for r in found]


class Model:
    """Languages by code point order, log probabilities (slot, language), and which languages use which script."""

    def __init__(self, languages: list[str], scores: np.ndarray, allowed: np.ndarray):
        self.languages, self.scores, self.allowed = languages, scores, allowed

    def bytes_at_once(self) -> int:
        """Text bytes of a piece, so that its scores take bounded memory."""
        return SCORED_BYTES * SCORED_LANGUAGES // max(SCORED_LANGUAGES, len(self.languages))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
        """Per text: the language of most letters, its share of the letters, and the spans (first word, past the last, language)."""
        grams, count = Grams(texts), len(self.languages)
        n = len(grams.begins)
        if not n or not count:
            return ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        word = np.add.reduceat(self.scores[grams.slots], grams.begins, axis=0).astype(np.float32)
        narrowed = self.allowed[grams.script]
        word = np.where(narrowed | ~narrowed.any(axis=1)[:, None], word, _NEVER)
        path = self._path(word, grams.first)
        weight = np.zeros((len(texts), count))
        np.add.at(weight, (grams.row, path), grams.letters)
        total, best = weight.sum(axis=1), weight.argmax(axis=1)
        label = [self.languages[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        score = np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0)
        turn = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (grams.row[1:] != grams.row[:-1])]))
        spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for a, b in zip(turn.tolist(), [*turn[1:].tolist(), n], strict=True):
            r = int(grams.row[a])
            spans[r].append((a - int(grams.first[r]), b - int(grams.first[r]), self.languages[path[a]]))
        return label, score, spans

    def _path(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best language of each word; rows run from first[i] to first[i + 1]. Ties go to the earlier language, and to staying."""
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[:-1][order], lengths[order]
        alive = np.searchsorted(-lengths, -np.arange(1, int(lengths.max()) + 1), side="right")
        moved = np.zeros(word.shape, bool)
        source = np.zeros(len(word), np.int32)
        held = word[begin[: alive[0]]]
        for t in range(1, len(alive)):
            k = alive[t]
            at = begin[:k] + t
            if k < len(held):
                word[begin[k : len(held)] + t - 1] = held[k:]
            held = held[:k]
            peak = held.argmax(axis=1)
            jump = held[np.arange(k), peak][:, None] - np.float32(SWITCH)
            go = jump > held
            moved[at], source[at] = go, peak
            held = np.where(go, jump, held) + word[at]
        word[begin[: len(held)] + len(alive) - 1] = held
        # back: the last words hold the totals
        path = np.zeros(len(word), np.int32)
        now = np.zeros(alive[0], np.int64)
        upto = 0
        for t in range(len(alive) - 1, -1, -1):
            k = alive[t]
            at = begin[:k] + t
            if k > upto:
                now[upto:k] = word[at[upto:k]].argmax(axis=1)
                upto = k
            own = now[:k]
            path[at] = own
            if t:
                now[:k] = np.where(moved[at, own], source[at], own)
        return path


def fit(labelled: DataFrame, limit: int = FIT_DOCUMENTS) -> Model:
    """labelled: doc_id, text, lang. Fits on the rows with a lang whose doc_id has the least hashes, about limit of each language.

    So a rare language is fitted on all that it has. Null langs and texts are left out; no rows give a model without languages.
    """
    rows = labelled.where("lang is not null and text is not null").select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    # hashes are uniform, so this part of their range holds about limit rows; the driver gets a number for each language
    parts = {r.lang: min(1.0, limit / r.rows) for r in rows.groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    if any(p < 1 for p in parts.values()):
        table = F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*map(F.lit, parts.values())))
        rows = rows.where((F.col("h").cast("double") / float(1 << 64) + 0.5) <= table[F.col("lang")])
    found = dict(_counts(rows))
    languages = sorted(found)
    counts, words = np.zeros((SLOTS, len(languages))), np.zeros((len(_NAMES), len(languages)))
    for i, lang in enumerate(languages):
        counts[:, i], words[:, i] = np.split(found[lang], [SLOTS])
    allowed = words >= 0.001 * words.sum(axis=0)
    if languages:
        used = max(1, int((counts.sum(axis=1) > 0).sum()))
        counts = np.log((counts + _SMOOTH) / (counts.sum(axis=0) + _SMOOTH * used))
    return Model(languages, counts.astype(np.float32), allowed)


def identify(documents: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in lang_pred), and with spans the labelled spans in words.

    Null text, text without letters (marks alone are none), or a model without languages: `und`, score 0. Rows with a null
    doc_id keep it, repeated rows repeat their result, ties go to the language first by code point. Texts are read whole, however long. An empty
    table gives no rows. Other columns, whatever their names, are ignored.
    """
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<first:int,past:int,lang:string>>" if spans else "")

    def predict(batches):
        for batch in batches:
            for piece in pieces(batch, "text", model.bytes_at_once()):
                label, score, parts = model.predict(piece.column("text").to_pylist())
                columns, names = [piece.column("doc_id"), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
                if spans:
                    columns.append(pa.array([[{"first": a, "past": b, "lang": x} for a, b, x in p] for p in parts], pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("lang", pa.string())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(giving_back(predict), schema)


def held_out() -> F.Column:
    """crc32 of doc_id as text, mod 4, is 2; a null doc_id is held out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def language_id(documents: DataFrame) -> DataFrame:
    """Fits on the documents that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = fit(documents.select("doc_id", "text", "lang").where(~held_out()))
    return identify(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def in_a_language(documents: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The documents, with all their columns, whatever their names, of which a language is known and holds at least that share of the letters."""

    def keep(batches):
        for batch in batches:
            for piece in pieces(batch, "text", model.bytes_at_once()):
                label, score, _ = model.predict(piece.column("text").to_pylist())
                yield piece.filter(pa.array((np.array(label, object) != "und") & (score >= least)))

    return documents.mapInArrow(giving_back(keep), documents.schema)
