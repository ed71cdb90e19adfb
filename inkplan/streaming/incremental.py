"""Documents page by page from a stream: shapes and classes are the state, pages are not kept.

A row adds a page to its document or, with finish set, ends it: then the encoded document comes out and later rows of it
are refused with an error row. Rows of one document within a trigger are taken in order of page_no, the end last. There is no event
time in this, so no watermark: a document stays open until its end arrives; of a finished one a single byte is kept.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from inkplan.functions import shapes, symbols
from inkplan.plans.options import Encoding, check_bitmap

EVENTS = "doc_id long, page_no int, width int, height int, x_dpi int, y_dpi int, packed binary, finish boolean"
#: What is kept of a finished document.
_DONE = b"."
OUT = "doc_id long, globals binary, pages array<binary>, error string"


class Document:
    """An open document."""

    def __init__(self, options: Encoding):
        self.options, self.pages, self.done = options, [], False
        self.classes = symbols.Classes(options.symbol_threshold, options.symbol_weight)

    def add(self, width: int, height: int, x_dpi: int | None, y_dpi: int | None, packed: bytes) -> None:
        if self.done:
            raise ValueError("the document is finished")
        check_bitmap(width, height)
        self.classes.add_page(len(self.pages), shapes.unpack(packed, width, height))
        self.pages.append((width, height, self.options.dpi or x_dpi or 0, self.options.dpi or y_dpi or 0))

    def finish(self) -> tuple[bytes | None, list[bytes]]:
        if self.done:
            raise ValueError("the document is finished")
        out = symbols.assemble(self.classes, self.pages, self.options)
        self.done, self.classes, self.pages = True, None, []
        return out


def encode_stream(events: DataFrame, options: Encoding = Encoding(mode="lossy")) -> DataFrame:
    """OUT rows of EVENTS rows: a document at its end, or what was wrong with a row."""

    def run(key, batches, state):
        book = Document(options)
        if state.exists:
            held = state.get[0]
            book.done = held == _DONE
            if not book.done:
                book.classes, book.pages = pickle.loads(held)
        out = []
        # Arrow cuts a trigger's rows anywhere: they are put in order first
        rows = pd.concat(list(batches))
        rows = rows.assign(finish=rows["finish"].fillna(False).astype(bool)).sort_values(["finish", "page_no"], kind="stable")
        for r in rows.itertuples(index=False):
            try:
                if r.finish:
                    head, streams = book.finish()
                    out.append((key[0], head, streams, None))
                elif r.packed is None or pd.isna(r.width) or pd.isna(r.height):
                    raise ValueError("a page needs a width, a height and its bits")
                else:
                    whole = lambda v: 0 if pd.isna(v) else int(v)
                    book.add(int(r.width), int(r.height), whole(r.x_dpi), whole(r.y_dpi), r.packed)
            except ValueError as e:
                out.append((key[0], None, None, str(e)))
        state.update((_DONE if book.done else pickle.dumps((book.classes, book.pages)),))
        yield pd.DataFrame(out, columns=["doc_id", "globals", "pages", "error"])

    return events.groupBy("doc_id").applyInPandasWithState(run, OUT, "book binary", "append", GroupStateTimeout.NoTimeout)
