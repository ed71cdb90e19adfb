"""Encoding plans over DataFrames of pages.

pages: doc_id long, page_no int, width int, height int, x_dpi int, y_dpi int, packed binary - rows of bits, leftmost
highest, 1 = black, each row filled up to a byte. Lossless pages are independent of each other: one narrow pass, no
shuffle. Lossy documents share symbols: pages are dealt by doc_id and sorted, and a task takes them as a stream, so that it
holds the shapes of one document and one batch of pages. Pages with a null doc_id are one document, whose doc_id is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkplan.functions import shapes, symbols
from inkplan.plans.options import Encoding, check_bitmap

PAGES = "doc_id long, page_no int, width int, height int, x_dpi int, y_dpi int, packed binary"
_COLUMNS = ["doc_id", "page_no", "width", "height", "x_dpi", "y_dpi", "packed"]


def _bitmap(width: int | None, height: int | None, packed: bytes | None) -> np.ndarray:
    if width is None or height is None or packed is None:
        raise ValueError("a page needs a width, a height and its bits")
    check_bitmap(width, height)
    if len(packed) < -(-width // 8) * height:
        raise ValueError("a page has fewer bits than its size")
    return shapes.unpack(packed, width, height)


def _dpi(options: Encoding, own: int | None) -> int:
    return options.dpi if options.dpi > 0 else own or 0


def encode_lossless(pages: DataFrame, options: Encoding = Encoding()) -> DataFrame:
    """doc_id, page_no, width, height, stream: each page as one generic region."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True)
            out = [symbols.lossless(_bitmap(w, h, data), _dpi(options, x), _dpi(options, y), options) for _, _, w, h, x, y, data in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "page_no", "width", "height")), pa.array(out, pa.binary())], ["doc_id", "page_no", "width", "height", "stream"])

    return pages.select(*_COLUMNS).mapInArrow(run, "doc_id long, page_no int, width int, height int, stream binary")


def _classified(batches, options: Encoding) -> Iterator[tuple[int | None, symbols.Classes, list[tuple[int, int, int, int]]]]:
    """doc_id, classes and page sizes of each document, as soon as its last page has come; pages are in order of doc_id and page_no."""
    key, classes, sizes = None, None, []
    for batch in batches:
        for doc, _, width, height, x_dpi, y_dpi, packed in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
            if classes is None or doc != key:
                if classes is not None:
                    yield key, classes, sizes
                key, classes, sizes = doc, symbols.Classes(options.symbol_threshold, options.symbol_weight), []
            classes.add_page(len(sizes), _bitmap(width, height, packed))
            sizes.append((width, height, _dpi(options, x_dpi), _dpi(options, y_dpi)))
    if classes is not None:
        yield key, classes, sizes


def _by_document(pages: DataFrame, run, schema: str) -> DataFrame:
    return pages.select(*_COLUMNS).repartition("doc_id").sortWithinPartitions("doc_id", "page_no").mapInArrow(run, schema)


def classify(pages: DataFrame, options: Encoding = Encoding(mode="lossy")) -> DataFrame:
    """doc_id, comp_no, page_no (rank in the document), x, y, width, height, class_no, ul_x, ul_y of every shape, classes merged if the options say so."""
    names = ["doc_id", "comp_no", "page_no", "x", "y", "width", "height", "class_no", "ul_x", "ul_y"]

    def run(batches):
        for doc, classes, _ in _classified(batches, options):
            if options.merge:
                classes.merge_blocks() if options.merge_by_hash else classes.merge_all()
            own = [(i, s.page, s.x, s.y, s.bits.shape[1], s.bits.shape[0], s.kind, s.left, s.top) for i, s in enumerate(classes.members)]
            columns = zip(*own, strict=True) if own else [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(own), pa.int64()), *(pa.array(c, pa.int32()) for c in columns)], names)

    return _by_document(pages, run, "doc_id long, " + ", ".join(f"{n} int" for n in names[1:]))


def encode_lossy(pages: DataFrame, options: Encoding = Encoding(mode="lossy")) -> DataFrame:
    """doc_id, globals (null if there are none), pages array<binary>, sizes array of width and height: symbol mode, one document at a time."""
    size = pa.struct([("width", pa.int32()), ("height", pa.int32())])

    def run(batches):
        for doc, classes, sizes in _classified(batches, options):
            head, streams = symbols.assemble(classes, sizes, options)
            own = [{"width": w, "height": h} for w, h, _, _ in sizes]
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([head], pa.binary()), pa.array([streams], pa.list_(pa.binary())), pa.array([own], pa.list_(size))], ["doc_id", "globals", "pages", "sizes"])

    return _by_document(pages, run, "doc_id long, globals binary, pages array<binary>, sizes array<struct<width:int,height:int>>")


def encode(pages: DataFrame, options: Encoding = Encoding()) -> DataFrame:
    """doc_id, globals, pages, sizes, output. In lossless mode a document is one page; a second one fails the query.

    Lossless streams, not pages, are then dealt by doc_id, to see that each document has one.
    """
    if options.mode == "lossy":
        done = encode_lossy(pages, options)
    else:
        size = F.struct(F.col("width"), F.col("height"))
        done = encode_lossless(pages, options).groupBy("doc_id").agg(F.collect_list("stream").alias("pages"), F.collect_list(size).alias("sizes"))
        single = F.when(F.size("pages") == 1, F.col("pages")).otherwise(F.raise_error(F.lit("a lossless document has one page")).cast("array<binary>"))
        done = done.select("doc_id", F.lit(None).cast("binary").alias("globals"), single.alias("pages"), "sizes")
    return done.withColumn("output", F.lit(options.output))


def _joined() -> F.Column:
    """Globals and pages end to end, in one pass over them."""
    return F.unhex(F.concat(F.coalesce(F.hex("globals"), F.lit("")), F.array_join(F.transform("pages", F.hex), "")))


def whole_file(encoded: DataFrame) -> DataFrame:
    """doc_id, file: globals and pages in order; embedded streams fail the query."""
    return encoded.select("doc_id", F.when(F.col("output") == "standalone", _joined()).otherwise(F.raise_error(F.lit("embedded streams are not a file")).cast("binary")).alias("file"))


def single_stream(encoded: DataFrame) -> DataFrame:
    """doc_id, stream: a file, or the one embedded page of a document without globals; anything else fails the query."""
    fits = (F.col("output") == "standalone") | (F.col("globals").isNull() & (F.size("pages") == 1))
    return encoded.select("doc_id", F.when(fits, _joined()).otherwise(F.raise_error(F.lit("several streams can't be one")).cast("binary")).alias("stream"))


def pdf_file(encoded: DataFrame) -> DataFrame:
    """doc_id, file: a PDF of embedded streams, an image per page; whole files fail the query."""
    from inkplan.sources.rasters import pdf

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("globals", "pages", "sizes", "output")), strict=True)
            files = []
            for head, pages, sizes, output in rows:
                if output != "embedded":
                    raise ValueError("a PDF takes embedded streams")
                files.append(pdf(pages, [(s["width"], s["height"]) for s in sizes], head))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "file"])

    return encoded.select("doc_id", "globals", "pages", "sizes", "output").mapInArrow(run, "doc_id long, file binary")
