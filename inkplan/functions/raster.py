"""Page kernels on numpy arrays: gray conversion, background cleaning, threshold and linear upsampling.

They compute per page what inkplan.operators.pixels states as relations over pixels.
"""

from __future__ import annotations

import numpy as np

from inkplan.plans.options import CHANNELS, LAYOUTS, PREMULTIPLIED, Binarization

# Fixed values of the cleaning step: tile size, ink limit, growth of ink, pixels that a tile needs, paper level, smoothing reach.
TILE_X, TILE_Y, INK, GROW, LEAST, PAPER, REACH_X, REACH_Y = 10, 15, 60, 3, 40, 200, 2, 1


def gray(pixels: bytes, width: int, height: int, stride: int, layout: str, how: str = "luma") -> np.ndarray:
    base = PREMULTIPLIED.get(layout, layout)
    size, at = LAYOUTS[base], CHANNELS[base]
    rows = np.zeros((height, stride), np.uint8)
    flat = np.frombuffer(pixels, np.uint8)[: height * stride]
    rows.reshape(-1)[: len(flat)] = flat
    cell = rows[:, : width * size].reshape(height, width, size).astype(np.int64)
    if layout in PREMULTIPLIED:
        cell = straight(cell)
    level = cell[:, :, at["g"]]
    if "r" in at and how == "luma":
        level = 19595 * cell[:, :, at["r"]] + 38470 * level + 7471 * cell[:, :, at["b"]] + 32768 >> 16
    if "a" in at:
        alpha = cell[:, :, at["a"]]
        level = np.where(alpha == 255, level, (level * alpha + 255 * (255 - alpha) + 127) // 255)
    return level.astype(np.uint8)


def straight(cell: np.ndarray) -> np.ndarray:
    """Four-channel pixels whose colors were multiplied by their alpha, the last channel, divided by it again, rounded; alpha 0 gives 0."""
    alpha = cell[..., 3:]
    color = np.where(alpha > 0, np.minimum(255, (cell[..., :3] * 255 + alpha // 2) // np.maximum(alpha, 1)), 0)
    return np.concatenate([color, alpha], axis=-1)


def _spread(mask: np.ndarray, reach: int) -> np.ndarray:
    for axis in (0, 1):
        wide = np.pad(mask, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)])
        mask = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis).any(axis=-1)
    return mask


def background(page: np.ndarray) -> np.ndarray:
    """Mean paper level of every complete tile, 0 where too little paper shows."""
    rows, columns = page.shape[0] // TILE_Y, page.shape[1] // TILE_X
    paper = ~_spread(page < INK, GROW)
    tiles = lambda m: m[: rows * TILE_Y, : columns * TILE_X].reshape(rows, TILE_Y, columns, TILE_X).sum(axis=(1, 3))
    total, count = tiles(np.where(paper, page, 0).astype(np.int64)), tiles(paper.astype(np.int64))
    return np.where(count >= LEAST, total // np.maximum(count, 1), 0)


def filled(tiles: np.ndarray, height: int, width: int) -> np.ndarray | None:
    """Holes closed: upwards and downwards in a column, then from the columns beside; None if nothing was measured."""
    table = np.zeros((height, width), np.int64)
    table[: tiles.shape[0], : tiles.shape[1]] = tiles
    known = (tiles > 0).any(axis=0)
    if not known.any():
        return None
    place = np.where(table > 0, np.arange(height)[:, None], -1)
    above = np.maximum.accumulate(place, axis=0)
    first = np.argmax(table > 0, axis=0)
    table = np.take_along_axis(table, np.where(above >= 0, above, first[None, :]), axis=0)
    source = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))
    source = np.where(source >= 0, source, np.argmax(known))
    return table[:, np.append(source, [source[-1]] * (width - len(known)))]


def inverse(table: np.ndarray) -> np.ndarray:
    """Smoothed by a clipped box mean, then the factor (of 256) that lifts it to paper."""
    sums = np.pad(table, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    ends = lambda n, reach: (np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n))
    (y0, y1), (x0, x1) = ends(table.shape[0], REACH_Y), ends(table.shape[1], REACH_X)
    total = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    cells = np.outer(y1 - y0, x1 - x0)
    mean = (total + cells // 2) // cells
    return np.where(mean > 0, 256 * PAPER // np.maximum(mean, 1), PAPER // 2)


def curve(gamma: float, black: int, white: int) -> np.ndarray:
    level = np.arange(256)
    x = np.clip((level - black).astype(np.float32) / np.float32(white - black), 0, None)
    bent = (255.0 * np.power(x, np.float32(1) / np.float32(gamma)).astype(np.float64) + 0.5).astype(np.int64)
    return np.where(level < black, 0, np.where(level > white, 255, np.clip(bent, 0, 255))).astype(np.uint8)


def clean(page: np.ndarray, gamma: float = 1.0, black: int = 90, white: int = 190) -> np.ndarray:
    """Paper to white. Pages under five tiles in either direction keep their levels but for the curve."""
    white = 190 if white > PAPER else white
    high, wide = -(-page.shape[0] // TILE_Y), -(-page.shape[1] // TILE_X)
    if high >= 5 and wide >= 5 and (table := filled(background(page), high, wide)) is not None:
        factor = inverse(table).repeat(TILE_Y, axis=0)[: page.shape[0]].repeat(TILE_X, axis=1)[:, : page.shape[1]]
        page = np.minimum(page.astype(np.int64) * factor >> 8, 255)
    return curve(gamma, black, white)[page]


def upsampled(page: np.ndarray, factor: int) -> np.ndarray:
    """Levels times 256, interpolated towards the right and the lower neighbour."""
    level = page.astype(np.int64)
    k = np.arange(factor)
    right = np.concatenate([level[:, 1:], level[:, -1:]], axis=1)
    wide = (((factor - k) * level[:, :, None] + k * right[:, :, None]) * 256 // factor).reshape(page.shape[0], -1)
    below = np.concatenate([wide[1:], wide[-1:]])
    return (((factor - k)[None, :, None] * wide[:, None, :] + k[None, :, None] * below[:, None, :]) // factor).reshape(-1, wide.shape[1])


def binarize(page: np.ndarray, options: Binarization = Binarization()) -> np.ndarray:
    if options.mode == "adaptive":
        page = clean(page, options.gamma, options.black, options.white)
    if options.upsample == 1:
        return (page < options.effective_threshold).astype(np.uint8)
    return (upsampled(page, options.upsample) < options.effective_threshold * 256).astype(np.uint8)
