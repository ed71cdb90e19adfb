"""Raster sources and stream sinks.

`read_images` reads PBM, PGM, PPM, PAM and PNG files with Spark's binaryFile reader; `ImageSource` registers the same as
format("inkimages"). `to_pages` binarizes interleaved rasters in one narrow pass. `EncodedSink` registers format("inkpages"),
which writes whole files, split parts or PDFs; files appear under their names when the job is committed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from inkplan.functions import images, raster, shapes
from inkplan.plans.options import Binarization, check_raster

RASTERS = "path string, width int, height int, stride int, layout string, pixels binary, x_dpi int, y_dpi int"
EXTENSIONS = (".jb2", ".jbig2")
MIME_TYPES = ("image/x-jbig2", "image/jbig2")
IMAGES = (".pbm", ".pgm", ".ppm", ".pam", ".png")
SINK_LAYOUTS = ("file", "split", "pdf")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """RASTERS of all such files under path, read by Spark's own reader from any store; a file of another kind fails the query."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                width, height, stride, layout, pixels, x_dpi, y_dpi = images.parse(data)
                yield pa.RecordBatch.from_pylist([{"path": name, "width": width, "height": height, "stride": stride, "layout": layout, "pixels": pixels, "x_dpi": x_dpi, "y_dpi": y_dpi}], _schema())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RASTERS)


def _schema() -> pa.Schema:
    return pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("stride", pa.int32()), ("layout", pa.string()), ("pixels", pa.binary()), ("x_dpi", pa.int32()), ("y_dpi", pa.int32())])


def to_pages(rasters: DataFrame, options: Binarization = Binarization()) -> DataFrame:
    """Adds to rasters (width, height, stride, layout, pixels, x_dpi, y_dpi) the binarized page: width, height, dpi and packed bits, in their place.

    Bits rasters keep their pixels; padding is dropped.
    """
    names = [c for c in rasters.columns if c not in ("stride", "layout", "pixels")]
    kinds = dict(rasters.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", packed binary"

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["layout"] == "Bits":
                    page = shapes.unpack(row["pixels"], row["width"], row["height"])
                else:
                    check_raster(row["width"], row["height"], row["stride"], row["layout"], len(row["pixels"]))
                    page = raster.binarize(raster.gray(row["pixels"], row["width"], row["height"], row["stride"], row["layout"], options.gray), options)
                grown = page.shape[1] // row["width"]
                row |= {"width": page.shape[1], "height": page.shape[0], "x_dpi": (row["x_dpi"] or 0) * grown, "y_dpi": (row["y_dpi"] or 0) * grown, "packed": shapes.pack(page)}
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in [*names, "packed"]} for r in rows], pa.schema([(c, batch.schema.field(c).type) for c in names] + [("packed", pa.binary())]))

    return rasters.mapInArrow(run, schema)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        return [_File(f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(IMAGES)]

    def read(self, partition):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_stream(partition.path, compression=None) as f:
            width, height, stride, layout, pixels, x_dpi, y_dpi = images.parse(f.read())
        yield partition.path, width, height, stride, layout, pixels, x_dpi, y_dpi


class ImageSource(DataSource):
    """spark.read.format("inkimages").load(path)."""

    @classmethod
    def name(cls):
        return "inkimages"

    def schema(self):
        return RASTERS

    def reader(self, schema):
        return _Reader(self.options["path"])


def pdf(pages: list[bytes], sizes: list[tuple[int, int]], head: bytes | None) -> bytes:
    """A minimal PDF of embedded streams: one image per page at 72 dpi, globals shared."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    stream = lambda entries, data: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (entries, len(data), data)
    add(b"<< /Type /Catalog /Pages 2 0 R >>")
    add(b"")
    shared = add(stream(b"", head)) if head is not None else None
    kids = []
    for data, (w, h) in zip(pages, sizes, strict=True):
        parms = b" /DecodeParms << /JBIG2Globals %d 0 R >>" % shared if shared else b""
        image = add(stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 1 /Filter /JBIG2Decode%s" % (w, h, parms), data))
        content = add(stream(b"", b"q %d 0 0 %d 0 0 cm /I Do Q" % (w, h)))
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /XObject << /I %d 0 R >> >> /Contents %d 0 R >>" % (w, h, image, content)))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def parts_of(name: str, layout: str, head: bytes | None, pages: list[bytes], output: str, sizes: list[tuple[int, int]] | None = None) -> list[tuple[str, bytes]]:
    """File names and contents of a document: layout file (one stream), split (name.sym if there are globals, name.0000 ...) or pdf."""
    if layout not in SINK_LAYOUTS:
        raise ValueError(f"layout {layout!r}; one of {', '.join(SINK_LAYOUTS)}")
    if layout == "split":
        return ([(f"{name}.sym", head)] if head is not None else []) + [(f"{name}.{i:04d}", p) for i, p in enumerate(pages)]
    if layout == "pdf":
        if output == "standalone" or sizes is None:
            raise ValueError("a PDF takes embedded streams and their sizes")
        return [(f"{name}.pdf", pdf(pages, sizes, head))]
    if output != "standalone" and (head is not None or len(pages) != 1):
        raise ValueError("several streams can't be one file; use layout split or pdf")
    return [(f"{name}{EXTENSIONS[0]}", (head or b"") + b"".join(pages))]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    """Tasks write to folders of their own below the target; the driver moves the files of the tasks that count, or none."""

    def __init__(self, path: str, layout: str, overwrite: bool):
        if layout not in SINK_LAYOUTS:
            raise ValueError(f"layout {layout!r}; one of {', '.join(SINK_LAYOUTS)}")
        self.path, self.layout, self.overwrite, self.job = path, layout, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows):
        store, path = _store(self.path)
        folder, names = f"{path}/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for row in rows:
            sizes = [(s["width"], s["height"]) for s in row.sizes] if "sizes" in row else None
            for name, data in parts_of("null" if row.doc_id is None else str(row.doc_id), self.layout, bytes(row.globals) if row.globals is not None else None, [bytes(p) for p in row.pages], row.output, sizes):
                with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
                    f.write(data)
                names.append(name)
        return _Written(folder, names)

    def commit(self, messages):
        from pyarrow import fs

        store, path = _store(self.path)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
        for message in messages:
            for name in message.names if message is not None else ():
                store.move(f"{message.folder}/{name}", f"{path}/{name}")
        self._clean(store, path)

    def abort(self, messages):
        self._clean(*_store(self.path))

    def _clean(self, store, path):
        from pyarrow import fs

        if store.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


class EncodedSink(DataSource):
    """encode(...).write.format("inkpages").option("layout", "file", "split" or "pdf").mode("append" or "overwrite").save(path).

    overwrite deletes the files of the target first, when all tasks are done. A failed job leaves the target as it was.
    """

    @classmethod
    def name(cls):
        return "inkpages"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("layout", "file"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSource)
    spark.dataSource.register(EncodedSink)
