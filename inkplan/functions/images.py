"""Image files to interleaved rasters: PBM, PGM, PPM, PAM (binary and plain, up to 16 bits) and PNG."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
_LAYOUT = {1: "Gray8", 2: "GrayAlpha16", 3: "Rgb24", 4: "Rgba32"}
# Fixed values of the PNG standard: channels of each color type; first column and row and steps of the seven passes.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


class ImageError(ValueError):
    """A file that is no image of these kinds, or a damaged one."""


def eight_bits(values: np.ndarray, most: int) -> np.ndarray:
    """Levels of 0 to most as 0 to 255, rounded."""
    return values.astype(np.uint8) if most == 255 else ((values.astype(np.int64) * 510 + most) // (2 * most)).astype(np.uint8)


def parse(data: bytes) -> tuple[int, int, int, str, bytes, int, int]:
    """width, height, stride, layout (Bits for PBM, 1 = black), pixels, and x and y dpi (0: unknown)."""
    return png(data) if data[:8] == PNG_MAGIC else (*netpbm(data), 0, 0)


def netpbm(data: bytes) -> tuple[int, int, int, str, bytes]:
    kind = data[:2]
    if kind == b"P7":
        head, end, body = data.partition(b"ENDHDR\n")
        fields = dict(parts for line in head.split(b"\n")[1:] if len(parts := line.split(None, 1)) == 2 and not line.startswith(b"#"))
        if not end or not {b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"} <= set(fields):
            raise ImageError("broken image header")
        width, height, depth, most = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        plain = False
    elif kind in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        bits, plain = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3")
        numbers, at = [], 2
        while len(numbers) < (2 if bits else 3):
            found = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)").match(data, at)
            if not found:
                raise ImageError("broken image header")
            numbers.append(int(found[1]))
            at = found.end()
        width, height, most = (*numbers, 1)[:3]
        depth, body = (0 if bits else 3 if kind in (b"P3", b"P6") else 1), data[at if plain else at + 1 :]
    else:
        raise ImageError("not a PBM, PGM, PPM, PAM or PNG file")
    if width <= 0 or height <= 0 or not 0 < most < 1 << 16 or depth not in (0, *_LAYOUT):
        raise ImageError("only positive sizes, one to four channels and levels of up to 16 bits are supported")
    if plain:
        body = re.sub(rb"#[^\n]*", b"", body)
        # plain bits need no blanks between them
        levels = np.array(list(re.sub(rb"\s+", b"", body)), np.int64) - 48 if depth == 0 else np.array(body.split(), np.int64)
    elif depth == 0:
        stride = -(-width // 8)
        if len(body) < stride * height:
            raise ImageError("image file is cut off")
        return width, height, stride, "Bits", body[: stride * height]
    else:
        size = width * height * depth * (1 if most < 256 else 2)
        if len(body) < size:
            raise ImageError("image file is cut off")
        levels = np.frombuffer(body[:size], np.uint8 if most < 256 else ">u2")
    if len(levels) < width * height * max(1, depth):
        raise ImageError("image file is cut off")
    levels = levels[: width * height * max(1, depth)]
    if ((levels < 0) | (levels > most)).any():
        raise ImageError("a level is beyond the largest")
    if depth == 0:
        return width, height, -(-width // 8), "Bits", np.packbits(levels.reshape(height, width).astype(np.uint8), axis=1).tobytes()
    return width, height, width * depth, _LAYOUT[depth], eight_bits(levels, most).tobytes()


# --- PNG ------------------------------------------------------------------------------------------------------------


def _chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data) or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ImageError(f"broken PNG chunk {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ImageError("PNG file is cut off")


def _unfiltered(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes after their filters are undone; step: bytes of a pixel, at least one."""
    rows = raw[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, row, above = rows[y, 0], rows[y, 1:], out[y]
        if kind == 1:
            wide = np.zeros(-(-stride // step) * step, np.uint8)
            wide[:stride] = row
            row = np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            own, up = row.tolist(), above.tolist()
            for i in range(stride):
                left, corner = (own[i - step], up[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) >> 1
                else:
                    # of the three neighbours, the one nearest to left + up - corner
                    d_left, d_up, d_corner = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
                    guess = left if d_left <= d_up and d_left <= d_corner else up[i] if d_up <= d_corner else corner
                own[i] = (own[i] + guess) & 255
            row = np.array(own, np.uint8)
        elif kind:
            raise ImageError(f"unknown PNG filter {kind}")
        out[y + 1] = row
    return out[1:]


def _samples(raw: np.ndarray, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """height x width x channels levels, and the bytes of raw that they took."""
    stride = -(-width * channels * depth // 8)
    if len(raw) < height * (stride + 1):
        raise ImageError("PNG file is cut off")
    rows = _unfiltered(raw, height, stride, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows.reshape(-1).view(">u2").reshape(height, -1).astype(np.uint16)
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return rows[:, : width * channels].reshape(height, width, channels), height * (stride + 1)


def png(data: bytes) -> tuple[int, int, int, str, bytes, int, int]:
    """All color types and depths, interlaced or not; palettes and transparent colors become RGBA, 16 bits become 8."""
    packed, palette, clear, dpi, head = [], None, None, (0, 0), None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"pHYs" and body[8] == 1:
            dpi = tuple(int(v * 0.0254 + 0.5) for v in struct.unpack(">II", body[:8]))
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[3] not in _CHANNELS or not head[0] or not head[1]:
        raise ImageError("broken PNG header")
    width, height, depth, color, _, _, interlaced = head
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ImageError(f"broken PNG data: {e}") from e
    channels = _CHANNELS[color]
    if interlaced:
        levels = np.zeros((height, width, channels), np.uint16 if depth == 16 else np.uint8)
        at = 0
        for x, y, dx, dy in _PASSES:
            if width > x and height > y:
                part, used = _samples(raw[at:], -(-(width - x) // dx), -(-(height - y) // dy), depth, channels)
                levels[y::dy, x::dx] = part
                at += used
    else:
        levels, _ = _samples(raw, width, height, depth, channels)
    if color == 3:
        if palette is None or int(levels.max()) >= len(palette):
            raise ImageError("a PNG pixel is not in the palette")
        table = np.concatenate([palette, np.full((len(palette), 1), 255, np.uint8)], axis=1)
        if clear is not None:
            table[: len(clear), 3] = np.frombuffer(clear, np.uint8)[: len(table)]
        levels = table[levels[:, :, 0]] if clear is not None else palette[levels[:, :, 0]]
    else:
        alpha = None
        if clear is not None and color in (0, 2):
            alpha = np.where((levels == np.frombuffer(clear, ">u2")[:channels]).all(axis=2), 0, 255).astype(np.uint8)
        levels = eight_bits(levels, (1 << depth) - 1)
        if alpha is not None:
            levels = np.concatenate([levels, alpha[:, :, None]], axis=2)
    depth = levels.shape[2]
    return width, height, width * depth, _LAYOUT[depth], np.ascontiguousarray(levels).tobytes(), *dpi
