import numpy as np
import pytest

from inkplan.functions import mq, segments, shapes, symbols
from inkplan.plans.options import Binarization, Encoding, check_raster
from tests import t88_decoder as t88

SIZES = [(1, 1), (2, 3), (7, 3), (8, 8), (31, 5), (32, 5), (33, 5), (63, 9), (64, 64), (65, 3), (100, 37), (257, 29)]


def noise(w, h, density, seed):
    return (np.random.default_rng(seed).random((h, w)) < density).astype(np.uint8)


def glyph_page(seed, kinds=5, w=200, h=60, noise_at=0.0):
    rng = np.random.default_rng(seed)
    shapes_of = [noise(7, 9, 0.6, k) | np.eye(9, 7, dtype=np.uint8) | np.pad(np.ones((9, 1), np.uint8), ((0, 0), (3, 3))) for k in range(kinds)]
    page = np.zeros((h, w), np.uint8)
    for y in range(2, h - 10, 14):
        for x in range(2, w - 10, 12):
            if rng.random() < 0.85:
                page[y : y + 9, x : x + 7] |= shapes_of[rng.integers(kinds)]
    return page


def encoded(pages, **options):
    o = Encoding(mode="lossy", **options)
    classes = symbols.Classes(o.symbol_threshold, o.symbol_weight)
    for i, p in enumerate(pages):
        classes.add_page(i, p)
    return symbols.assemble(classes, [(p.shape[1], p.shape[0], 0, 0) for p in pages], o)


def test_annex_h2():
    bits = np.unpackbits(np.frombuffer(bytes.fromhex("00020051000000C00352872AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF"), np.uint8))
    assert mq.encode(np.zeros(256), bits).hex() == "84c73bfce1a1430402200000410dbb86f4317fff88ff37471adb6adfffac"


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("typical", [False, True])
def test_lossless_round_trip(size, typical):
    for page in (np.zeros(size[::-1], np.uint8), np.ones(size[::-1], np.uint8), noise(*size, 0.3, 1), noise(*size, 0.03, 2)):
        whole = symbols.lossless(page, 300, 300, Encoding(duplicate_lines=typical))
        assert (t88.decode(whole)[0] == page).all()
        part = symbols.lossless(page, 300, 300, Encoding(duplicate_lines=typical, output="embedded"))
        assert whole[13 : 13 + len(part)] == part and b"\xff\xac" in part[-2:]


def test_damage_shows():
    page = noise(60, 40, 0.3, 3)
    data = bytearray(symbols.lossless(page, 0, 0, Encoding()))
    data[90] ^= 0x55
    assert (t88.decode(bytes(data))[0] != page).any()


@pytest.mark.parametrize("value", [0, 1, 3, 4, -1, -3, -4, 19, 20, -83, 84, 339, 340, -4435, 4436, 2_000_000_000, None])
def test_integers(value):
    stream = mq.Stream()
    stream.integer("IADH", value)
    stream.integer("IADH", 7)
    d = t88.Decoder(stream.coded())
    assert d.integer("IADH") == value and d.integer("IADH") == 7


def test_integers_out_of_range():
    with pytest.raises(ValueError):
        mq.integer("IADH", 2_000_000_001)


@pytest.mark.parametrize("pages", [1, 2, 3])
@pytest.mark.parametrize("output", ["standalone", "embedded"])
def test_crisp_pages_decode_exactly(pages, output):
    source = [glyph_page(s) for s in range(pages)] + [np.zeros((20, 30), np.uint8)]
    head, streams = encoded(source, output=output)
    for got, want in zip(t88.decode((head or b"") + b"".join(streams)), source, strict=True):
        assert (got == want).all()


def test_page_local_symbols():
    a, b = np.zeros((30, 30), np.uint8), np.zeros((30, 30), np.uint8)
    a[3:12, 4:9] = 1
    b[3:7, 4:20] = 1
    head, streams = encoded([a, b], output="embedded")
    assert head is None and [(p == q).all() for p, q in zip(t88.decode(b"".join(streams)), (a, b), strict=True)] == [True, True]


def test_merging_never_enlarges():
    rng = np.random.default_rng(5)
    pages = [glyph_page(9) ^ (rng.random((60, 200)) < 0.004).astype(np.uint8)]
    plain, _ = encoded(pages, output="embedded")
    for by_hash in (True, False):
        merged, _ = encoded(pages, output="embedded", merge=True, merge_by_hash=by_hash)
        assert len(merged) <= len(plain)


def test_components_partition_the_page():
    for seed, (w, h) in enumerate([(40, 30), (33, 17), (64, 64), (5, 50)]):
        page = noise(w, h, 0.35, seed)
        total, last = np.zeros_like(page, np.int64), (-1, -1)
        for x, y, bits in shapes.components(page):
            assert bits[0].any() and bits[-1].any() and bits[:, 0].any() and bits[:, -1].any()
            total[y : y + bits.shape[0], x : x + bits.shape[1]] += bits
            first = (y, x + int(np.argmax(bits[0])))
            assert first > last
            last = first
        assert (total == page).all()


def test_connectivity():
    page = np.eye(4, dtype=np.uint8)
    assert shapes.count_components(page, True) == 1 and shapes.count_components(page, False) == 4


def test_classes_in_order():
    # an L and a T on each of two pages
    page = np.zeros((20, 40), np.uint8)
    page[2:14, 2:4] = page[12:14, 2:10] = 1
    page[2:4, 20:32] = page[2:14, 25:27] = 1
    classes = symbols.Classes(0.92, 0.5)
    classes.add_page(0, page)
    classes.add_page(1, page)
    assert [s.kind for s in classes.members] == [0, 1, 0, 1] and [s.page for s in classes.members] == [0, 0, 1, 1]
    assert [(s.left, s.top) for s in classes.members[:2]] == [(2, 2), (20, 2)]


def test_small_templates_never_merge():
    bits = np.ones((4, 9), np.uint8)
    assert not shapes.equivalent(bits, bits)
    assert shapes.equivalent(np.ones((9, 9), np.uint8), np.ones((9, 9), np.uint8))


def test_equivalence_tells_noise_from_lines():
    a = np.ones((30, 30), np.uint8)
    scattered, line = a.copy(), a.copy()
    scattered[::9, ::9] = 0
    line[14:17, :] = 0
    assert shapes.equivalent(a, scattered) and not shapes.equivalent(a, line)


def test_headers():
    assert segments.segment(300, 6, 256, b"x", (299,), 2)[:6] == bytes([0, 0, 1, 44, 0x46, 0x22])
    with pytest.raises(ValueError):
        segments.segment(9, 6, 1, b"", (1, 2, 3, 4, 5))
    assert [segments.metres(d) for d in (300, 600, 150, 0)] == [11811, 23622, 5906, 0]


@pytest.mark.parametrize("bad", [{"dpi": -1}, {"dpi": 100_001}, {"symbol_threshold": 0.3}, {"symbol_threshold": float("nan")}, {"symbol_weight": 1.1}, {"mode": "x"}, {"output": "x"}])
def test_bad_encoding(bad):
    with pytest.raises(ValueError):
        Encoding(**bad)


@pytest.mark.parametrize("bad", [{"upsample": 3}, {"threshold": 256}, {"gamma": 0}, {"black": 190}, {"white": 256}, {"mode": "x"}, {"gray": "x"}])
def test_bad_binarization(bad):
    with pytest.raises(ValueError):
        Binarization(**bad)


def test_thresholds_default():
    assert Binarization().effective_threshold == 200 and Binarization(mode="global").effective_threshold == 128 and Binarization(threshold=-5).effective_threshold == 200


@pytest.mark.parametrize("args", [(0, 1, 1, "Gray8", 1), (2, 2, 1, "Gray8", 4), (2, 2, 6, "Rgb24", 11), (1, 1, 1, "x", 1)])
def test_bad_rasters(args):
    with pytest.raises(ValueError):
        check_raster(*args)
