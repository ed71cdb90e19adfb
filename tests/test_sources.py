"""Image files, the sink's commit, and the command line."""

import struct
import zlib

import numpy as np
import pytest

from inkplan import cli
from inkplan.functions import images, shapes
from inkplan.plans import document
from inkplan.plans.options import Encoding
from inkplan.sources import rasters
from tests import t88_decoder as t88


def filtered(rows: np.ndarray, step: int, kinds) -> bytes:
    """Rows of bytes with PNG filters, by their definition."""
    out, above = bytearray(), [0] * rows.shape[1]
    for y, row in enumerate(rows.tolist()):
        kind = kinds[y % len(kinds)]
        out.append(kind)
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        above = row
    return bytes(out)


def png(levels: np.ndarray, depth: int, color: int, interlaced=False, extra=b"", kinds=(0, 1, 2, 3, 4)) -> bytes:
    height, width, channels = levels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def rows(part):
        flat = part.reshape(part.shape[0], -1)
        if depth == 16:
            return flat.astype(">u2").view(np.uint8)
        if depth == 8:
            return flat.astype(np.uint8)
        bits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1) & 1).astype(np.uint8)
        return np.packbits(bits.reshape(flat.shape[0], -1), axis=1)

    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlaced else [(0, 0, 1, 1)]
    data = b"".join(filtered(rows(levels[y::dy, x::dx]), max(1, channels * depth // 8), kinds) for x, y, dx, dy in passes if width > x and height > y)
    half = len(packed := zlib.compress(data)) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, int(interlaced))) + extra + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize(("depth", "color"), [(1, 0), (2, 0), (4, 0), (8, 0), (16, 0), (8, 2), (16, 2), (8, 4), (16, 4), (8, 6), (16, 6)])
def test_png(depth, color, interlaced):
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    levels = np.random.default_rng(depth + color).integers(0, 1 << depth, (9, 13, channels))
    width, height, stride, layout, pixels, x_dpi, y_dpi = images.parse(png(levels, depth, color, interlaced))
    assert (width, height, stride, layout, x_dpi, y_dpi) == (13, 9, 13 * channels, {1: "Gray8", 2: "GrayAlpha16", 3: "Rgb24", 4: "Rgba32"}[channels], 0, 0)
    want = np.floor(levels * 255 / ((1 << depth) - 1) + 0.5)
    assert (np.frombuffer(pixels, np.uint8).reshape(levels.shape) == want).all()


def test_png_extras():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    place = np.random.default_rng(1).integers(0, 3, (5, 7, 1))
    palette = bytes([1, 2, 3, 40, 50, 60, 255, 0, 9])
    file = png(place, 2, 3, extra=chunk(b"PLTE", palette) + chunk(b"pHYs", struct.pack(">IIB", 11811, 5906, 1)))
    got = images.parse(file)
    assert got[3] == "Rgb24" and got[5:] == (300, 150) and got[4] == bytes(v for p in place.reshape(-1) for v in palette[3 * p : 3 * p + 3])
    clear = images.parse(png(place, 2, 3, extra=chunk(b"PLTE", palette) + chunk(b"tRNS", bytes([0, 128]))))
    assert clear[3] == "Rgba32" and list(clear[4][3::4]) == [(0, 128, 255)[p] for p in place.reshape(-1)]
    gray = images.parse(png(place, 8, 0, extra=chunk(b"tRNS", struct.pack(">H", 2))))
    assert gray[3] == "GrayAlpha16" and list(gray[4][1::2]) == [0 if p == 2 else 255 for p in place.reshape(-1)]
    for bad in (file[:-20], file.replace(b"IDAT", b"IDAX", 1), b"\x89PNG\r\n\x1a\n", png(place + 1, 2, 3, extra=chunk(b"PLTE", palette)), b"GIF89a"):
        with pytest.raises(images.ImageError):
            images.parse(bad)


def test_netpbm_kinds():
    page = (np.random.default_rng(3).random((4, 10)) < 0.5).astype(np.uint8)
    plain = b"P1\n# a note\n10 4\n" + b"\n".join("".join(map(str, r)).encode() for r in page.tolist())
    assert images.netpbm(plain) == (10, 4, 2, "Bits", shapes.pack(page))
    assert images.netpbm(b"P2 3 1 15\n0 7 15")[4] == bytes([0, 119, 255]) and images.netpbm(b"P3 1 1 255 # c\n1 2 3\n")[3:] == ("Rgb24", bytes([1, 2, 3]))
    deep = np.array([0, 1, 128, 32768, 65279, 65535])
    assert images.netpbm(b"P5 6 1 65535\n" + deep.astype(">u2").tobytes())[4] == bytes(np.floor(deep * 255 / 65535 + 0.5).astype(np.uint8))
    assert images.netpbm(b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 4\nMAXVAL 1000\nENDHDR\n" + np.array([0, 500, 1000, 1000], ">u2").tobytes())[3:] == ("Rgba32", bytes([0, 128, 255, 255]))
    for bad in (b"P5 2 2 255\n123", b"P5 0 2 255\n", b"P2 1 1 9\n12", b"P6 1", b"P7\nWIDTH 1\nENDHDR\n", b"P1 3 1\n10", b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 5\nMAXVAL 9\nENDHDR\n12345"):
        with pytest.raises(ValueError):
            images.netpbm(bad)


def pages(spark, count):
    page = np.zeros((12, 20), np.uint8)
    page[2:9, 3:8] = 1
    return page, spark.createDataFrame([(i, k, 20, 12, 0, 0, bytearray(shapes.pack(page))) for i in range(count) for k in range(2)], document.PAGES)


def test_sink(spark, tmp_path):
    rasters.register(spark)
    page, some = pages(spark, 3)
    out = tmp_path / "out"
    embedded = document.encode(some, Encoding(mode="lossy", output="embedded"))
    save = lambda df, layout, mode: df.write.format("inkpages").option("layout", layout).mode(mode).save(str(out))
    names = lambda: sorted(p.name for p in out.iterdir())
    save(embedded, "pdf", "append")
    assert names() == ["0.pdf", "1.pdf", "2.pdf"] and all((out / n).read_bytes().startswith(b"%PDF") for n in names())
    assert (out / "1.pdf").read_bytes() == bytes(document.pdf_file(embedded.where("doc_id = 1")).first().file)
    whole = document.encode(some.where("doc_id < 2"), Encoding(mode="lossy"))
    save(whole, "file", "append")
    assert names() == ["0.jb2", "0.pdf", "1.jb2", "1.pdf", "2.pdf"] and (t88.decode((out / "0.jb2").read_bytes())[1] == page).all()
    # a task that fails leaves the target as it was
    with pytest.raises(Exception, match="one file"):
        save(embedded, "file", "overwrite")
    assert len(names()) == 5
    with pytest.raises(Exception, match="layout"):
        save(whole, "zip", "overwrite")
    save(whole, "file", "overwrite")
    assert names() == ["0.jb2", "1.jb2"]


def test_command_line(spark, tmp_path, capsysbinary, monkeypatch):
    page = (np.random.default_rng(4).random((40, 60)) < 0.1).astype(np.uint8)
    image, other = tmp_path / "a.pbm", tmp_path / "b.png"
    image.write_bytes(b"P4 60 40\n" + shapes.pack(page))
    other.write_bytes(png((1 - page)[:, :, None] * 255, 8, 0))
    monkeypatch.chdir(tmp_path)
    assert cli.run([]) == 1 and cli.run(["--version"]) == 0 and b"inkplan" in capsysbinary.readouterr().out
    assert cli.run(["-h"]) == 0 and b"--symbol-mode" in capsysbinary.readouterr().out
    for flags in (["-o", "x.jb2"], ["-d", "-o", "x.jb2"], ["-G", "-o", "x.jb2", str(other)]):
        assert cli.run([*flags, *([] if str(other) in flags else [str(image)])]) == 0
        assert (t88.decode((tmp_path / "x.jb2").read_bytes())[0] == page).all(), flags
    assert cli.run([str(image)]) == 0 and (t88.decode(capsysbinary.readouterr().out)[0] == page).all()
    assert cli.run([str(image), str(other)]) == 2 and b"one image" in capsysbinary.readouterr().err
    assert cli.run(["-s", "-G", "-p", "-b", "book", str(image), str(other)]) == 0
    parts = sorted(p.name for p in tmp_path.glob("book.*"))
    assert parts[:2] == ["book.0000", "book.0001"] and all(q.shape == page.shape for q in t88.decode(b"".join((tmp_path / n).read_bytes() for n in [*parts[2:], *parts[:2]])))
    assert cli.run(["-s", "-t", "0.1", str(image)]) == 2 and cli.run([str(tmp_path / "missing.pbm")]) == 2
    assert cli.run(["-G", "-2", "-D", "600", "-o", "y.jb2", str(other)]) == 0 and t88.decode((tmp_path / "y.jb2").read_bytes())[0].shape == (80, 120)
