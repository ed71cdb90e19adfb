"""Token-ID output: one wavelet matrix file per shard, and its reader.

A shard holds the ids of consecutive documents. Its bits are laid out plane by plane, highest bit first: each plane
has one bit per token, and the tokens are then stably parted by that bit before the next plane. A directory of ones
per 512 bits beside each plane gives rank in constant time and select by binary search, so token access, counting and
occurrence lookup read the planes and never the ids.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import get_file, giving_back, pieces, put_file, scratch, stored

MAGIC = b"WMTX0001"
#: A shard is closed by the document that brings it to so many tokens.
SHARD_TOKENS = 1 << 21
#: Words and pieces of words that a worker remembers at most.
CACHE_WORDS = 800_000
_BLOCK = 512


# --- the file -----------------------------------------------------------------------------------------------------


def _ones_before(words: np.ndarray) -> np.ndarray:
    """Ones before each block of 512 bits."""
    per = np.bitwise_count(words).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)


def pack_shard(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """One file: ids of consecutive documents, of the given lengths, under the given doc_ids (None allowed)."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    left = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    sections, zeros = [], []
    for b in range(bits - 1, -1, -1):
        plane = np.zeros(-(-n // _BLOCK) * _BLOCK // 8, np.uint8)
        packed = np.packbits((left & left.dtype.type(1 << b)) != 0, bitorder="little")
        plane[: len(packed)] = packed
        sections += [squeeze(plane.tobytes()), squeeze(_ones_before(plane.view(np.uint64)).tobytes())]
        # Arrow parts by the bits as they are, in half the time that numpy takes
        on, values = pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(plane)]), pa.array(left)
        low, high = np.asarray(values.filter(pc.invert(on))), np.asarray(values.filter(on))
        zeros.append(len(low))
        left = np.concatenate([low, high])
    sections += [squeeze(json.dumps(doc_ids).encode()), squeeze(np.asarray(lengths, np.int64).tobytes())]
    head = json.dumps({"n": n, "bits": bits, "zeros": zeros, "docs": len(doc_ids), "sizes": [len(s) for s in sections]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(sections)


class Shard:
    """Reads one file. Planes are unpacked when first used."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        at = np.concatenate([[0], np.cumsum(head["sizes"])]) + 12 + size
        if at[-1] != len(data):
            raise ValueError(f"shard of {len(data)} bytes, {at[-1]} declared")
        self._part = lambda i: zstandard.ZstdDecompressor().decompress(data[at[i] : at[i + 1]])
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.doc_ids = json.loads(self._part(2 * self.bits))
        self.lengths = np.frombuffer(self._part(2 * self.bits + 1), np.int64)

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._planes:
            self._planes[k] = np.frombuffer(self._part(2 * k), np.uint64), np.frombuffer(self._part(2 * k + 1), np.uint32)
        return self._planes[k]

    def _rank(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        words, ones = self._plane(k)
        block, word = i // _BLOCK, i // 64
        total = int(ones[block]) + int(np.bitwise_count(words[block * 8 : word]).sum())
        return total + (int(words[word]) & ((1 << i % 64) - 1)).bit_count() if i % 64 else total

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            words, _ = self._plane(k)
            bit = int(words[i // 64]) >> i % 64 & 1
            ones = self._rank(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._rank(k, begin), self._rank(k, end)
            begin, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.bits - 1 - k) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often token stands in places begin to end - 1."""
        a, b = self._range(token, begin, self.n if end is None else end)
        return b - a

    def find(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of token, or -1."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= j < b - a:
            return -1
        i = a + j
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids: the planes are undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            words, _ = self._plane(k)
            on = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~on)] = values[: self.zeros[k]]
            above[np.flatnonzero(on)] = values[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            values = above
        return values


# --- encoding -----------------------------------------------------------------------------------------------------

# The rules of a vocabulary file for which there is a quicker way, and its cuts for characters up to U+00FF.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
#: Texts of these characters alone are lower-cased, cut and normalised alike by the library and by Python.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xac\xae-\xff]*")


class WordIds(dict):
    """Word to its ids as bytes of kind; each piece of a word is a word too, encoded once by the library's model.

    That holds for files with _RULES; texts of any other file, or with characters or tokens beyond them, go to the library whole.
    """

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.quick = all(rules.get(k) == v for k, v in _RULES.items()) and not rules["model"].get("dropout")
        self.added = [t["content"] for t in rules.get("added_tokens") or ()]
        most = max([end_id, *self.tokenizer.get_vocab(True).values()])
        self.kind = "<u2" if most < 1 << 16 else "<u4"
        self.code = "H" if most < 1 << 16 else "I"
        self.model, self.cuts = self.tokenizer.model, re.compile(_CUTS).findall
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(256, 512))
        self.letters = {b: chr(b if b in shown else next(spare)) for b in range(256)}

        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            # letters alone are one piece, and a piece is cut no further
            if word.isalpha() or len(cut := self.cuts(word)) == 1:
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                out = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
            else:
                out = b"".join(map(self.__getitem__, cut))
        if len(self) >= CACHE_WORDS // 2:
            # words that stood in neither half are forgotten, frequent ones come back
            self.older = self.copy()
            self.clear()
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.quick and _PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            # one call looks all words up; it takes two keys at least to give a tuple
            return b"".join(itemgetter("", "", *text.lower().split())(self))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


_ENCODERS: dict[tuple[str, int], WordIds] = {}


def write_shards(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes whole texts (null: empty), appends end_id to each, and writes shards in ascending doc_id order to folder.

    Rows are range-partitioned by doc_id (nulls first) and sorted; ties go by the text's hash and the text. Returns a
    stored table (uri, part, shard, n_tokens, start): start is the number of ids in all shards before. A task holds one
    shard's ids at a time; a file is moved into place whole, so a retried task leaves the same files.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        part = TaskContext.get().partitionId()
        if (tokenizer_path, end_id) not in _ENCODERS:
            _ENCODERS[tokenizer_path, end_id] = WordIds(tokenizer_path, end_id)
        words = _ENCODERS[tokenizer_path, end_id]
        encode, end = words.encode, np.array([end_id], words.kind).tobytes()
        size = len(end)
        names, lengths, ids, held, shard = [], [], [], 0, 0

        def close():
            nonlocal names, lengths, ids, held, shard
            uri = f"{folder}/{part:06d}-{shard:05d}.wmtx"
            put_file(uri, pack_shard(np.frombuffer(b"".join(ids), words.kind), names, np.array(lengths)))
            row = pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([held], pa.int64())], ["uri", "part", "shard", "n_tokens"])
            names, lengths, ids, held, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            for piece in pieces(batch, "text"):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    data = encode(text or "") + end
                    names.append(doc_id)
                    lengths.append(len(data) // size)
                    ids.append(data)
                    held += len(data) // size
                    if held >= shard_tokens:
                        yield close()
        if names:
            yield close()

    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    shards = stored(ordered.select("doc_id", "text").mapInArrow(giving_back(write), "uri string, part int, shard int, n_tokens long"), f"{folder}/shards")
    # ids before a shard: those of the parts before, of which there are as many as partitions, and of its own part
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(upto(Window.orderBy("part"))), none).alias("earlier"))
    own = F.coalesce(F.sum("n_tokens").over(upto(Window.partitionBy("part").orderBy("shard"))), none)
    return shards.withColumn("own", own).join(totals, "part").withColumn("start", F.col("earlier") + F.col("own")).drop("own", "earlier")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (of all its ids as little-endian 32-bit)."""
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(get_file(uri))
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("uri", "start").repartition(parts, "uri").mapInArrow(giving_back(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(documents: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes shards and reads them back. documents: doc_id and text; other columns, whatever their names, are ignored.

    Null and empty texts have the end id alone; texts are encoded whole, however long. Rows with a null doc_id come first, repeated rows
    stand side by side, ties go by the text. An empty table gives no rows.

    The files stay in folder; by default it is one of scratch(), which goes with the process.
    """
    folder = folder or scratch(documents.sparkSession, "tokens")
    return read_shards(write_shards(documents, folder, tokenizer_path, end_id, shard_tokens))
