"""Kernels on one bitmap: runs, connected components, features, correlation and symbol equivalence.

Bitmaps are numpy arrays of rows of 0 and 1.
"""

from __future__ import annotations

import numpy as np

#: White pixels around a shape while it is classified.
BORDER = 6
# The sizes around a shape's own that are searched, in this order.
WALK = [
    (0, 0), (0, 1), (-1, 0), (0, -1), (1, 0), (-1, 1), (1, 1), (-1, -1), (1, -1), (0, -2), (2, 0), (0, 2), (-2, 0),
    (-1, -2), (1, -2), (2, -1), (2, 1), (1, 2), (-1, 2), (-2, 1), (-2, -1), (-2, -2), (2, -2), (2, 2), (-2, 2),
]
_PARTS = 9


def unpack(data: bytes, width: int, height: int) -> np.ndarray:
    stride = -(-width // 8)
    return np.unpackbits(np.frombuffer(data, np.uint8, stride * height).reshape(height, stride), axis=1, count=width)


def pack(page: np.ndarray) -> bytes:
    return np.packbits(page, axis=1).tobytes()


def runs(page: np.ndarray) -> np.ndarray:
    """(y, left, right), both inclusive, in raster order."""
    wide = np.zeros((page.shape[0], page.shape[1] + 2), np.int8)
    wide[:, 1:-1] = page
    step = np.diff(wide, axis=1)
    y, left = np.nonzero(step == 1)
    return np.stack([y, left, np.nonzero(step == -1)[1] - 1], axis=1)


def labels(found: np.ndarray, eight: bool = True) -> np.ndarray:
    """For each run, the first run (in raster order) of its component."""
    reach, n = int(eight), len(found)
    label = np.arange(n)
    if not n:
        return label
    y, left, right = (found[:, k].astype(np.int64) for k in range(3))
    # runs of the row above that a run touches are consecutive
    span = int(right.max()) + 3
    low = np.searchsorted((y * span + right), (y - 1) * span + left - reach, "left")
    high = np.searchsorted((y * span + left), (y - 1) * span + right + reach, "right")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + low[a]
    while len(a):
        # every root takes the least root that it touches; then all point at their roots again
        p, q = label[a], label[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    return label


def page_runs(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several pages below each other, a row apart so that none touches another; the page of each run; each page's first row."""
    found = [runs(p) for p in pages]
    heights = np.array([p.shape[0] + 2 for p in pages], np.int64)
    tops = np.cumsum(heights) - heights
    own = np.repeat(np.arange(len(pages)), [len(f) for f in found])
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    every[:, 0] += tops[own]
    return every, own, tops


def component_counts(pages: list[np.ndarray], eight: bool = True) -> np.ndarray:
    """Components of each page."""
    found, own, _ = page_runs(pages)
    return np.bincount(own[labels(found, eight) == np.arange(len(found))], minlength=len(pages))


def count_components(page: np.ndarray, eight: bool = True) -> int:
    return int(component_counts([page], eight)[0])


def component_table(pages: list[np.ndarray], bitmaps: bool = True) -> dict[str, np.ndarray]:
    """Every 8-connected shape of the pages, page by page in raster order of first pixels, as columns.

    page, number (on its page), x, y, w, h, area, cx, cy (the centroid from the corner of the bordered shape) and, if asked
    for, bits: a list of tight bitmaps.
    """
    found, own, tops = page_runs(pages)
    label = labels(found)
    order = np.argsort(label, kind="stable")
    label = label[order]
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else np.zeros(0, np.int64)
    if not len(first):
        empty = np.zeros(0, np.int64)
        return {c: empty for c in ("page", "number", "x", "y", "w", "h", "area")} | {"cx": np.zeros(0, np.float32), "cy": np.zeros(0, np.float32), "bits": []}
    y, left, right = found[order].T.astype(np.int64)
    page = own[order][first]
    out = {"page": page, "number": np.arange(len(first)) - np.searchsorted(page, page), "x": np.minimum.reduceat(left, first), "y": np.minimum.reduceat(y, first)}
    out["w"], out["h"] = np.maximum.reduceat(right, first) + 1 - out["x"], np.maximum.reduceat(y, first) + 1 - out["y"]
    count = np.diff(np.append(first, len(order)))
    x0, y0, n = np.repeat(out["x"], count), np.repeat(out["y"], count), right - left + 1
    out["area"] = np.add.reduceat(n, first)
    xs = np.add.reduceat(n * (left + right - 2 * x0 + 2 * BORDER) // 2, first)
    ys = np.add.reduceat(n * (y - y0 + BORDER), first)
    area = out["area"].astype(np.float32)
    out["cx"], out["cy"] = xs.astype(np.float32) / area, ys.astype(np.float32) / area
    large = np.flatnonzero(np.maximum(xs, ys) >= 1 << 24)
    if bitmaps or len(large):
        # all bitmaps lie end to end; each run is filled by the places of its pixels
        size = out["w"] * out["h"]
        begin = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.uint8)
        start = np.repeat(begin, count) + (y - y0) * np.repeat(out["w"], count) + left - x0
        flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = 1
        cut = lambda i: flat[begin[i] : begin[i] + size[i]].reshape(out["h"][i], out["w"][i])
        for i in large.tolist():
            _, out["cx"][i], out["cy"][i] = measure(cut(i))
        out["bits"] = [cut(i) for i in range(len(first))] if bitmaps else []
    out["y"] = out["y"] - tops[page]
    return out


def components(page: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(x, y, tight bitmap) of each 8-connected shape, in raster order of first pixels."""
    found = component_table([page])
    return list(zip(found["x"].tolist(), found["y"].tolist(), found["bits"], strict=True))


def measure(bits: np.ndarray) -> tuple[int, np.float32, np.float32]:
    """Ink, and the centroid from the corner of the bordered shape. Sums are exact below 2 ** 24, above in order of rows from below."""
    area = int(bits.sum())
    per_row, per_column = bits.sum(axis=1, dtype=np.int64), bits.sum(axis=0, dtype=np.int64)
    xs = int((per_column * (np.arange(bits.shape[1]) + BORDER)).sum())
    ys = int((per_row * (np.arange(bits.shape[0]) + BORDER)).sum())
    if max(xs, ys) >= 1 << 24:
        fx = fy = np.float32(0)
        for y in range(bits.shape[0] - 1, -1, -1):
            at = np.flatnonzero(bits[y]) + BORDER
            # a word's four bytes from right to left
            for w in np.unique(at // 32).tolist():
                for b in (3, 2, 1, 0):
                    inside = at[(at // 8) == 4 * w + b]
                    fx = np.float32(fx + np.float32(inside.sum()))
            fy = np.float32(fy + np.float32(int(per_row[y]) * (y + BORDER)))
        return area, np.float32(fx / np.float32(area)), np.float32(fy / np.float32(area))
    return area, np.float32(np.float32(xs) / np.float32(area)), np.float32(np.float32(ys) / np.float32(area))


def away(v: np.float32) -> int:
    """Rounded half away from zero; the half is added in single precision."""
    return int(v + np.float32(0.5)) if v >= 0 else int(v - np.float32(0.5))


def threshold_for(threshold: float, weight: float, area: int, box: int) -> float:
    t, w = float(np.float32(threshold)), float(np.float32(weight))
    return float(np.float32(t + (1.0 - t) * w * area / box)) if w > 0 else t


def overlap(a: np.ndarray, b: np.ndarray, dx: int, dy: int) -> int:
    """Ink that a shares with b moved by (dx, dy)."""
    y0, y1, x0, x1 = max(dy, 0), min(b.shape[0] + dy, a.shape[0]), max(dx, 0), min(b.shape[1] + dx, a.shape[1])
    return int((a[y0:y1, x0:x1] & b[y0 - dy : y1 - dy, x0 - dx : x1 - dx]).sum()) if y0 < y1 and x0 < x1 else 0


def window(page: np.ndarray, x: int, y: int, template: np.ndarray) -> np.ndarray:
    """The page under a bordered template at (x, y), white outside; a pixel wider than the template on all sides."""
    top, left, h, w = y - 1, x - 1, template.shape[0] + 2, template.shape[1] + 2
    y0, y1, x0, x1 = max(top, 0), min(top + h, page.shape[0]), max(left, 0), min(left + w, page.shape[1])
    if (y0, y1, x0, x1) == (top, top + h, left, left + w):
        return page[y0:y1, x0:x1]
    out = np.zeros((h, w), np.uint8)
    if y0 < y1 and x0 < x1:
        out[y0 - top : y1 - top, x0 - left : x1 - left] = page[y0:y1, x0:x1]
    return out


def best_shift(under: np.ndarray, template: np.ndarray) -> tuple[int, int]:
    """The move by at most a pixel that differs least from the window under a template; the first of equals."""
    # the ink of both is the same for every move: the one that shares most differs least
    moves = np.lib.stride_tricks.sliding_window_view(under, template.shape)
    best = int((moves & template).sum(axis=(2, 3)).argmax())
    return best % 3 - 1, best // 3 - 1


def _cuts(size: int) -> np.ndarray:
    """Ends of nine parts of a side; the first size mod 9 are a pixel longer."""
    part, extra = divmod(size, _PARTS)
    return np.concatenate([[0], np.cumsum([part + (i < extra) for i in range(_PARTS)])])


def equivalent(first: np.ndarray, second: np.ndarray) -> bool:
    """Whether two templates of one size differ by scattered noise only; not symmetric: the first's ink sets the limit."""
    if first.shape != second.shape:
        return False
    differs = np.pad(first ^ second, BORDER).astype(np.int64)
    if differs.sum() > int(int(first.sum()) * 0.25):
        return False
    rows, columns = _cuts(differs.shape[0]), _cuts(differs.shape[1])
    tall, wide = differs.shape[0] // _PARTS, differs.shape[1] // _PARTS
    halves = lambda cut: np.stack([cut[:-1], (cut[:-1] + cut[1:]) // 2], axis=1).reshape(-1)
    table = np.pad(differs.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))

    def cells(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
        ys, xs = np.append(ys, differs.shape[0]), np.append(xs, differs.shape[1])
        return np.diff(np.diff(table[np.ix_(ys, xs)], axis=0), axis=1)

    squares = lambda m: m[:-1, :-1] + m[1:, :-1] + m[:-1, 1:] + m[1:, 1:]
    across, down = int(wide * (tall // 2) * 0.9), int(tall * (wide // 2) * 0.9)
    whole = cells(rows[:-1], columns[:-1])
    if (squares(cells(rows[:-1], halves(columns))) >= across).any() or (squares(cells(halves(rows), columns[:-1])) >= down).any():
        return False
    falling = whole[:-2, :-2] + whole[1:-1, 1:-1] + whole[2:, 2:]
    rising = whole[:-2, 2:] + whole[1:-1, 1:-1] + whole[2:, :-2]
    if (falling >= across).any() or (rising >= across).any():
        return False
    return not (squares(whole) >= np.float32((tall // 2) * (wide // 2) * np.pi)).any()


def block_of(bits: np.ndarray) -> int:
    """Equivalent templates are sought among those of the same pieces and size."""
    return (count_components(bits, eight=False) + 10 * (bits.shape[0] + 2 * BORDER) + 10_000 * (bits.shape[1] + 2 * BORDER)) % 10_000_000
