"""Connected components of pages, as a narrow pass per page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkplan.functions import shapes

#: Pixels that are labelled at once, at least a page.
_AT_ONCE = 1 << 24


def _groups(batch: pa.RecordBatch):
    """Rows of a batch, by places and bitmaps, of about _AT_ONCE pixels each."""
    rows = list(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "packed")), strict=True))
    at, held, size = 0, [], 0
    for i, (w, h, data) in enumerate(rows):
        held.append(shapes.unpack(data, w, h))
        size += w * h
        if size >= _AT_ONCE or i + 1 == len(rows):
            yield at, held
            at, held, size = i + 1, [], 0


def components(pages: DataFrame, packed: bool = True) -> DataFrame:
    """doc_id, page_no, comp_no (in raster order of first pixels), x, y, w, h, area, cx, cy and, if asked for, packed of every 8-connected shape."""
    schema = "doc_id long, page_no int, comp_no long, x long, y long, w long, h long, area long, cx float, cy float" + (", packed binary" if packed else "")
    names = ["comp_no", "x", "y", "w", "h", "area", "cx", "cy"]

    def run(batches):
        for batch in batches:
            for at, held in _groups(batch):
                found = shapes.component_table(held, packed)
                own = pa.array(found["page"] + at)
                columns = [batch.column("doc_id").take(own), batch.column("page_no").take(own), *(pa.array(found["number" if c == "comp_no" else c]) for c in names)]
                if packed:
                    columns.append(pa.array([shapes.pack(b) for b in found["bits"]], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "page_no", *names, *(["packed"] if packed else [])])

    return pages.select("doc_id", "page_no", "width", "height", "packed").mapInArrow(run, schema)


def component_counts(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, and the number of 4- and of 8-connected components."""

    def run(batches):
        for batch in batches:
            counts = [np.stack([shapes.component_counts(held, e) for e in (False, True)]) for _, held in _groups(batch)]
            both = np.concatenate(counts, axis=1) if counts else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_no"), *(pa.array(c, pa.int64()) for c in both)], ["doc_id", "page_no", "four", "eight"])

    return pages.select("doc_id", "page_no", "width", "height", "packed").mapInArrow(run, "doc_id long, page_no int, four long, eight long")


def down_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Black pixels strictly below each row; rows: by, y, n."""
    from pyspark.sql import Window

    below = Window.partitionBy(*by).orderBy(F.col("y").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0).cast("long")))
