"""What the operators of this subpackage share: the shared folder, files in it, and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches are worked through in pieces of about this many text bytes, which bounds the numpy temporaries.
PIECE_BYTES = 2 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWER = np.uint64(0x5851F42D4C957F2D)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share; it goes when the driver's process ends.

    Where that is unset, a local master gets a folder of its own; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{(folder := tempfile.mkdtemp(prefix='inkplan-'))}"
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/inkplan/{spark.sparkContext.applicationId}"
    if own not in _SCRATCH:
        # whatever ends the process, an exception included, what its queries left is deleted
        _SCRATCH[own] = name
        atexit.register(_forget, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, uri: str) -> None:
    try:
        discard(spark, uri)
    except Exception:  # noqa: BLE001 - the JVM may be gone; then the folder is left to whoever keeps the shared one
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df begins with, in any case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, uri: str) -> DataFrame:
    """The rows of df, computed once and kept as a table at uri; later plans start from there.

    The shuffle files of the write are deleted as soon as it ends, so a job of many steps needs the disk of its largest.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(uri)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(uri)


def discard(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of scratch()."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._jsc is None else spark._jsc.hadoopConfiguration()).delete(path, True)


def put_file(uri: str, data: bytes) -> None:
    """Writes a file whole: under a name of its own first, then moved, so that a retried or doubled task leaves one good file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}", compression=None) as out:
        out.write(data)
    store.move(part, path)


def get_file(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as source:
        return source.read()


def give_back() -> None:
    """Memory that this process has freed goes back to the system.

    Python's workers outlive their tasks and Spark keeps several per executor: what their allocators hold on to adds up.
    """
    pa.default_memory_pool().release_unused()
    # glibc's; other C libraries have none
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(run):
    """run, a function for mapInArrow, followed by give_back() when a task has come to its end."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES):
    """Slices of batch whose texts in column take about limit bytes each; a longer text is a slice of its own.

    What the work on them has freed is given back after the last one.
    """
    texts = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    if not len(sizes):
        return
    piece = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
    give_back()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 places where each begins; null counts as empty."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _B
        h = (h ^ (h >> np.uint64(27))) * _C
        return h ^ (h >> np.uint64(31))


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class IdFilter:
    """A set of longs that may hold some more: four bits of one 64-bit word for each id, 8 MB at most whatever the ids' number.

    Beyond the four million ids that this serves well it lets more and more others through, which a join then removes.
    spare: how many times the words that four ids a word take; the more, the fewer others pass.
    """

    MOST_WORDS = 1 << 20

    def __init__(self, ids: DataFrame, column: str, count: int, spare: int = 1):
        size = 1 << 10
        while size * 4 < count * spare and size < self.MOST_WORDS:
            size *= 2

        def words(batches):
            for batch in batches:
                at, bits = IdFilter._place(np.asarray(batch.column(0), np.int64), size)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["word", "bits"])

        def columns(batches):
            # whole columns as bytes: the driver gets a few values, not a row for each word
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(c, np.int64).tobytes()], pa.binary()) for c in batch.columns], ["word", "bits"])

        from pyspark.sql import functions as F

        self.bits = np.zeros(size, np.uint64)
        merged = ids.select(F.col(column).cast("long").alias("id")).where("id is not null").mapInArrow(giving_back(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        for at, bits in merged.mapInArrow(giving_back(columns), "word binary, bits binary").collect():
            self.bits[np.frombuffer(at, np.int64)] = np.frombuffer(bits, np.int64).view(np.uint64)

    @staticmethod
    def _word(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(ids.view(np.uint64) + np.uint64(1))
        return h, (h >> np.uint64(32)).astype(np.int64) & (size - 1)

    @staticmethod
    def _place(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        h, at = IdFilter._word(ids, size)
        return at, IdFilter._bits(h)

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        bits = np.zeros(len(h), np.uint64)
        for i in range(4):
            bits |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        return bits

    def holds(self, ids: np.ndarray) -> np.ndarray:
        h, at = self._word(ids, len(self.bits))
        word = self.bits[at]
        out = word != 0
        # most words hold nothing that matters: bits are made for the others alone
        some = np.flatnonzero(out)
        bits = self._bits(h[some])
        out[some] = word[some] & bits == bits
        return out


class Words:
    """The words of a column of texts: first and past-the-end byte, row, and a 64-bit hash each.

    Words are `[^\\x20\\x09-\\x0D]+`, or what lies between bytes of another table of separators; fold takes A-Z as a-z.
    """

    def __init__(self, texts: pa.Array, fold: bool = True, separators: np.ndarray = _WHITE):
        raw, self.offsets = text_bytes(texts)
        n = len(texts)
        if fold:
            raw = _FOLD[raw]
        solid = ~separators[raw]
        head, tail = np.ones(len(raw), bool), np.ones(len(raw), bool)
        head[1:] = ~solid[:-1]
        tail[:-1] = ~solid[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        head[inner] = True
        tail[inner - 1] = True
        self.starts, self.ends = np.flatnonzero(solid & head), np.flatnonzero(solid & tail) + 1
        self.row = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.hash = self._hashes(raw[solid], self.ends - self.starts)
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    @staticmethod
    def _hashes(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(lengths):
            return np.zeros(0, np.uint64)
        begins = np.cumsum(lengths) - lengths
        with np.errstate(over="ignore"):
            powers = np.full(int(lengths.max()), _POWER, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            place = np.arange(len(letters)) - np.repeat(begins, lengths)
            sums = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[place], begins)
            return mixed(sums + lengths.astype(np.uint64) * _A)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words inside a row; a row of 1 to k - 1 words gives its whole sequence as one."""
    h, n = words.hash, len(words.hash)
    with np.errstate(over="ignore"):
        size = max(0, n - k + 1)
        full = np.zeros(size, np.uint64)
        for i in range(k):
            full = (full ^ h[i : i + size]) * _A + np.uint64(k)
        keep = words.row[:size] == words.row[k - 1 : k - 1 + size]
        out, rows = mixed(full[keep]), words.row[: len(keep)][keep]
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for i in range(k - 1):
                there = counts[short] > i
                own[there] = (own[there] ^ h[words.first[short[there]] + i]) * _A + counts[short[there]].astype(np.uint64)
            out, rows = np.concatenate([out, mixed(own)]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            out, rows = out[order], rows[order]
    return out, rows
