from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkplan.functions import raster, shapes, symbols
from inkplan.operators import bitmaps, pixels
from inkplan.plans import document
from inkplan.plans.options import Binarization, Encoding
from inkplan.sources import rasters
from inkplan.streaming import incremental
from tests import t88_decoder as t88


def frame(page):
    y, x = np.indices(page.shape)
    return pd.DataFrame({"page_no": 0, "x": x.ravel(), "y": y.ravel(), "g": page.ravel().astype(np.int64)})


def matrix(df, column, shape):
    out = np.full(shape, -1, np.int64)
    for r in df.select("x", "y", column).collect():
        out[r.y, r.x] = r[2]
    return out


@pytest.fixture(scope="module")
def gray():
    rng = np.random.default_rng(4)
    page = (rng.integers(120, 240, (70, 52)) + np.linspace(-60, 15, 52)).clip(0, 255).astype(np.uint8)
    page[20:30, 10:30] = 20
    return page


def test_cleaning_equals_the_kernel(spark, gray):
    df = spark.createDataFrame(frame(gray))
    assert (matrix(pixels.cleaned(df), "g", gray.shape) == raster.clean(gray)).all()
    small = gray[:60, :52]
    assert (matrix(pixels.cleaned(spark.createDataFrame(frame(small))), "g", small.shape) == raster.clean(small)).all()


@pytest.mark.parametrize("factor", [2, 4])
def test_upsampling_equals_the_kernel(spark, gray, factor):
    part = gray[:9, :7]
    got = matrix(pixels.upsampled(spark.createDataFrame(frame(part)), factor), "v", (9 * factor, 7 * factor))
    assert (got == raster.upsampled(part, factor)).all()


def test_all_ink_stays_unmapped():
    page = np.full((80, 60), 10, np.uint8)
    assert (raster.clean(page) == raster.curve(1.0, 90, 190)[page]).all()


def test_white_over_paper_is_190():
    page = np.tile(np.arange(256, dtype=np.uint8), (3, 1))
    assert (raster.clean(page, white=230) == raster.clean(page, white=190)).all()


def test_layouts():
    px = bytes([10, 20, 30, 255, 40, 50, 60, 0])
    rgba, bgra = (raster.gray(px, 2, 1, 8, layout) for layout in ("Rgba32", "Bgra32"))
    assert rgba.tolist() == [[(19595 * 10 + 38470 * 20 + 7471 * 30 + 32768) >> 16, 255]] and bgra[0, 0] == (19595 * 30 + 38470 * 20 + 7471 * 10 + 32768) >> 16
    assert raster.gray(bytes([100, 128]), 1, 1, 2, "GrayAlpha16")[0, 0] == (100 * 128 + 255 * 127 + 127) // 255
    assert raster.gray(px, 2, 1, 8, "Rgba32", "green")[0, 0] == 20


def test_premultiplied():
    cell = np.array([50, 100, 128, 128, 9, 9, 9, 0, 1, 2, 3, 255]).reshape(1, 3, 4)
    plain = raster.straight(cell)
    assert plain.reshape(-1).tolist() == [100, 199, 255, 128, 0, 0, 0, 0, 1, 2, 3, 255]
    # a stride of 16 bytes, the last row without its padding
    data = np.pad(cell.astype(np.uint8).reshape(1, 12), ((0, 1), (0, 4))).tobytes()[:28]
    got = raster.gray(data, 3, 2, 16, "PremultipliedRgba32")
    assert got[0].tolist() == raster.gray(plain.astype(np.uint8).tobytes(), 3, 1, 12, "Rgba32")[0].tolist() and got[1].tolist() == [255] * 3


def test_word_rows(spark):
    rng = np.random.default_rng(0)
    page = (rng.random((6, 45)) < 0.5).astype(np.uint8)
    rows = spark.createDataFrame([(1, y, bytearray(np.packbits(r).tobytes())) for y, r in enumerate(page)], "doc_id long, y long, data binary")
    words = bitmaps.from_packed(rows, 45)
    back = {r.y: bytes(r.data) for r in bitmaps.to_packed(words, 45).collect()}
    assert back == {y: np.packbits(r).tobytes() for y, r in enumerate(page)}
    inverted = {r.y: bytes(r.data) for r in bitmaps.to_packed(bitmaps.from_packed(rows, 45, False), 45, False).collect()}
    assert all(np.unpackbits(np.frombuffer(inverted[y], np.uint8))[:45].tolist() == r.tolist() for y, r in enumerate(page))
    found = sorted((r.y, r.l, r.r) for r in bitmaps.runs_of_rows(words, 45, ["doc_id"]).collect())
    assert found == [tuple(r) for r in shapes.runs(page).tolist()]
    moved = bitmaps.unbordered(bitmaps.bordered(words, 6, 45), 6, 57, 18)
    assert {r.y: r.words for r in moved.collect()} == {r.y: r.words for r in words.collect()}


def pages_of(spark, items):
    return spark.createDataFrame([(d, n, p.shape[1], p.shape[0], 0, 0, bytearray(shapes.pack(p))) for d, n, p in items], document.PAGES)


def test_pages_without_a_document(spark):
    page = (np.random.default_rng(4).random((20, 40)) < 0.04).astype(np.uint8)
    pages = pages_of(spark, [(d, n, page) for d in (None, 7) for n in range(2)])
    encoded = {r.doc_id: (r.globals, r.pages) for r in document.encode_lossy(pages).collect()}
    assert set(encoded) == {None, 7} and encoded[None] == encoded[7]
    shapes_of = lambda d: sorted(tuple(r)[1:] for r in classified if r.doc_id == d)
    classified = document.classify(pages).collect()
    assert shapes_of(None) == shapes_of(7) != []


def test_documents_round_trip(spark):
    rng = np.random.default_rng(1)
    sparse = lambda: (rng.random((20, 40)) < 0.04).astype(np.uint8)
    items = [(d, n, sparse()) for d in (1, 2) for n in range(3)]
    options = Encoding(mode="lossy", symbol_threshold=0.98)
    files = {r.doc_id: bytes(r.file) for r in document.whole_file(document.encode(pages_of(spark, items), options)).collect()}
    for d in (1, 2):
        for got, (_, _, want) in zip(t88.decode(files[d]), [i for i in items if i[0] == d], strict=True):
            assert (got != want).mean() <= 0.03
    single = document.whole_file(document.encode(pages_of(spark, items[:1]), Encoding())).first()
    assert (t88.decode(bytes(single.file))[0] == items[0][2]).all()
    with pytest.raises(Exception, match="one page"):
        document.whole_file(document.encode(pages_of(spark, items), Encoding())).collect()
    with pytest.raises(Exception, match="not a file"):
        document.whole_file(document.encode(pages_of(spark, items[:1]), Encoding(output="embedded"))).collect()
    with pytest.raises(Exception, match="can't be one"):
        document.single_stream(document.encode(pages_of(spark, items), Encoding(mode="lossy", output="embedded"))).collect()


def test_sources_and_sinks(spark, tmp_path):
    page = (np.random.default_rng(2).random((11, 19)) < 0.3).astype(np.uint8)
    (tmp_path / "a.pbm").write_bytes(b"P4\n# note\n19 11\n" + shapes.pack(page))
    (tmp_path / "b.pgm").write_bytes(b"P5 19 11 255\n" + ((1 - page) * 255).astype(np.uint8).tobytes())
    (tmp_path / "c.ppm").write_bytes(b"P6\n19 11\n255\n" + np.repeat((1 - page) * 255, 3).astype(np.uint8).tobytes())
    (tmp_path / "d.pam").write_bytes(b"P7\nWIDTH 19\nHEIGHT 11\nDEPTH 2\nMAXVAL 255\nTUPLTYPE GRAYSCALE_ALPHA\nENDHDR\n" + np.stack([(1 - page) * 255, np.full_like(page, 255)], axis=-1).astype(np.uint8).tobytes())
    rasters.register(spark)
    for read in (rasters.read_images(spark, str(tmp_path)), spark.read.format("inkimages").load(str(tmp_path))):
        done = rasters.to_pages(read, Binarization(mode="global")).collect()
        assert len(done) == 4 and all((shapes.unpack(bytes(r.packed), 19, 11) == page).all() for r in done)
    encoded = document.encode(pages_of(spark, [(7, 0, page), (7, 1, page)]), Encoding(mode="lossy", output="embedded"))
    encoded.write.format("inkpages").option("layout", "split").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["7.0000", "7.0001", "7.sym"]
    assert [(p == page).all() for p in t88.decode(b"".join((tmp_path / "out" / n).read_bytes() for n in ("7.sym", "7.0000", "7.0001")))] == [True, True]
    row = encoded.first()
    book = rasters.pdf([bytes(p) for p in row.pages], [(19, 11)] * 2, bytes(row.globals))
    assert book.startswith(b"%PDF-1.4") and book.count(b"/JBIG2Globals") == 2 and book.rstrip().endswith(b"%%EOF")


def test_incremental_documents(spark, tmp_path):
    page = np.zeros((12, 20), np.uint8)
    page[2:9, 3:8] = 1
    rows = [(1, 0, 20, 12, 0, 0, bytearray(shapes.pack(page)), False), (1, 1, 20, 12, 0, 0, bytearray(shapes.pack(page)), False), (1, 2, None, None, None, None, None, True)]
    spark.createDataFrame(rows, incremental.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(incremental.EVENTS).parquet(str(tmp_path / "in"))
    job = incremental.encode_stream(stream, Encoding(mode="lossy")).writeStream.format("memory").queryName("books").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    job.processAllAvailable()
    job.stop()
    done = spark.table("books").collect()
    assert len(done) == 1 and done[0].error is None
    want = document.encode_lossy(pages_of(spark, [(1, 0, page), (1, 1, page)]), Encoding(mode="lossy")).first()
    assert bytes(done[0].globals) == bytes(want.globals) and [bytes(p) for p in done[0].pages] == [bytes(p) for p in want.pages]


def test_late_pages_are_refused():
    page = np.zeros((12, 20), np.uint8)
    page[2:9, 3:8] = 1
    state = incremental.Document(Encoding(mode="lossy"))
    state.add(20, 12, 0, 0, shapes.pack(page))
    assert state.finish()[1]
    with pytest.raises(ValueError, match="finished"):
        state.add(20, 12, 0, 0, shapes.pack(page))
    with pytest.raises(ValueError, match="finished"):
        state.finish()
    with pytest.raises(ValueError, match="page"):
        incremental.Document(Encoding(mode="lossy")).finish()


def test_oracles_agree(spark):
    """Every query with SQL, on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    import os

    from inkplan.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    for name in ORACLES:
        df = QUERIES[name](spark, sf)
        columns = sorted(df.columns)
        got = Counter(tuple(map(rounded, r)) for r in df.select(*columns).collect())
        want = Counter(tuple(map(rounded, r)) for r in con.sql(ORACLES[name]).select(*(f'"{c}"' for c in columns)).fetchall())
        assert got == want, (name, list((got - want).items())[:3], list((want - got).items())[:3])
    assert symbols.bits_for(5) == 3 and F is not None


def _no_broadcast(spark, query, folder):
    """The query's rows, planned where Spark takes every table for small."""
    from inkplan.queries import QUERIES

    df = QUERIES[query](spark, folder)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["correlation_pairs", "correlation_wide", "placement_wide", "placement_refined"])
def test_bitmaps_are_not_gathered_on_the_driver(spark, query):
    _no_broadcast(spark, query, "/root/testdata/sf0.001")


def test_overlaps_of_bitmaps_with_missing_rows(spark):
    from inkplan.operators import symbols as sym

    rows = spark.createDataFrame([(1, 0, [0xF0000000]), (1, 3, [0x0F000000]), (2, 1, [0xF0000000]), (2, 2, [0xFFFFFFFF]), (2, 4, [0x3C000000])], "key long, y long, words array<long>")
    pairs = spark.createDataFrame([(1, 2, 0, 0), (1, 2, 0, -1), (1, 2, 2, -1), (2, 1, 0, 1), (1, 9, 0, 0)], "a long, b long, dx int, dy int")
    got = {tuple(r) for r in sym.overlaps(pairs, rows).collect()}
    assert got == {(1, 2, 0, 0, 0), (1, 2, 0, -1, 6), (1, 2, 2, -1, 6), (2, 1, 0, 1, 6), (1, 9, 0, 0, 0)}


@pytest.mark.parametrize("query", ["placement_wide", "placement_refined"])
def test_placements_fold_no_words_in_lambdas(spark, query):
    """Nine moves of every word as interpreted lambdas didn't end on millions of pairs."""
    from inkplan.queries import QUERIES

    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(sequence" not in plan and "MapInArrow" in plan


def test_moves_of_bitmaps_with_far_rows(spark):
    """Rows far apart take no memory for the white ones between them."""
    from inkplan.operators import symbols as sym

    far = 1 << 40
    rows = spark.createDataFrame([(1, 0, [0x18000000]), (1, far, [0x1, 0x80000000]), (2, 1, [0x0C000000]), (2, far + 1, [0x0, 0xC0000000]), (3, 5, [0x0])], "key long, y long, words array<long>")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 9)], "a long, b long")
    got = {tuple(r) for r in sym.refined(pairs, rows).collect()}
    assert got == {(1, 2, -1, -1, 0), (2, 1, 1, 1, 0), (1, 3, -1, -1, 4)}


def test_overlaps_against_kernels_on_one_pair():
    import pyarrow as pa

    from inkplan.functions import overlaps, shapes

    rng = np.random.default_rng(5)
    pages = [rng.random((rng.integers(1, 9), 32 * rng.integers(1, 4))) < 0.4 for _ in range(60)]
    batches = []
    for key, page in enumerate(pages):
        words = np.packbits(page, axis=1).view(">u4").astype(np.int64).tolist()
        for y in rng.permutation(len(words)).tolist():
            batches.append((key, y, words[y]))
    rows = pa.RecordBatch.from_arrays([pa.array([r[0] for r in batches]), pa.array([r[1] for r in batches]), pa.array([r[2] for r in batches], pa.list_(pa.int64()))], ["key", "y", "words"])
    packed = [overlaps.pack_rows(x) for x in (rows.slice(0, 100), rows.slice(100))]
    parts = [[part for b in packed for k, part in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True) if k == key] for key in range(60)]
    bits = pa.array(parts, pa.list_(pa.binary()))
    a, b = bits.slice(0, 30), bits.slice(30)
    dx, dy = rng.integers(-70, 70, 30), rng.integers(-3, 4, 30)
    found = overlaps.Pairs(a, b, (3, 70))
    assert found.shared(dx, dy).tolist() == [shapes.overlap(pages[i], pages[30 + i], int(dx[i]), int(dy[i])) for i in range(30)]
    x, y, differs = found.best()
    for i in range(30):
        both = [(pages[i].sum() + pages[30 + i].sum() - 2 * shapes.overlap(pages[i], pages[30 + i], u, v), 3 * (v + 1) + u + 1) for v in (-1, 0, 1) for u in (-1, 0, 1)]
        assert min(both) == (differs[i], 3 * (y[i] + 1) + x[i] + 1)
    with pytest.raises(ValueError, match="two rows"):
        overlaps.Pairs(a, pa.array([p + p for p in parts[30:]], pa.list_(pa.binary())), (1, 1))


def test_rows_of_texts_by_code_points():
    import pyarrow as pa

    from inkplan.functions import overlaps

    texts = ["é€😀aŁ", "x" * 64 + "\U0001f600", "m", "ab" * 100]
    got = overlaps.text_rows(pa.array(range(9, 14)).slice(1), pa.array(["skipped ü", *texts]).slice(1), 64, 110).to_pylist()
    want = []
    for i, t in enumerate(texts):
        black = [ord(c) & 255 < 110 for c in t] + [False] * (-len(t) % 64)
        for y in range(len(black) // 64):
            line = black[64 * y : 64 * y + 64]
            want.append({"doc_id": 10 + i, "y": y, "words": [sum(v << (31 - k) for k, v in enumerate(line[32 * w : 32 * w + 32])) for w in (0, 1)]})
    assert got == want
