"""Settings of binarization and encoding; wrong ones fail when the plan is built."""

from __future__ import annotations

from dataclasses import dataclass

#: Bytes per pixel of the interleaved layouts.
LAYOUTS = {"Gray8": 1, "GrayAlpha16": 2, "Rgb24": 3, "Bgr24": 3, "Rgba32": 4, "Bgra32": 4}
#: Layouts whose colors were multiplied by their alpha, and what they are otherwise.
PREMULTIPLIED = {"PremultipliedRgba32": "Rgba32", "PremultipliedBgra32": "Bgra32"}
#: Where red, green, blue and alpha (or gray and alpha) lie inside a pixel.
CHANNELS = {"Gray8": {"g": 0}, "GrayAlpha16": {"g": 0, "a": 1}, "Rgb24": {"r": 0, "g": 1, "b": 2}, "Bgr24": {"b": 0, "g": 1, "r": 2}, "Rgba32": {"r": 0, "g": 1, "b": 2, "a": 3}, "Bgra32": {"b": 0, "g": 1, "r": 2, "a": 3}}
MOST_WORDS = (1 << 30) - 1


def _require(good: bool, text: str) -> None:
    if not good:
        raise ValueError(text)


@dataclass(frozen=True)
class Binarization:
    """mode: adaptive (background cleaned first) or global. threshold: any negative value means the mode's default."""

    mode: str = "adaptive"
    threshold: int = -1
    upsample: int = 1
    gray: str = "luma"
    gamma: float = 1.0
    black: int = 90
    white: int = 190

    def __post_init__(self):
        _require(self.mode in ("adaptive", "global"), f"mode {self.mode!r}")
        _require(self.gray in ("luma", "green"), f"gray {self.gray!r}")
        _require(self.upsample in (1, 2, 4), "upsample must be 1, 2 or 4")
        _require(self.threshold <= 255, "threshold must be at most 255")
        _require(not self.gamma <= 0, "gamma must be positive")
        _require(0 <= self.black < self.white <= 255, "0 <= black < white <= 255 must hold")

    @property
    def effective_threshold(self) -> int:
        return self.threshold if self.threshold >= 0 else 128 if self.mode == "global" else 200


@dataclass(frozen=True)
class Encoding:
    """mode: lossless or lossy. output: standalone (a file) or embedded (streams for a PDF)."""

    mode: str = "lossless"
    output: str = "standalone"
    duplicate_lines: bool = False
    dpi: int = 0
    symbol_threshold: float = 0.92
    symbol_weight: float = 0.5
    merge: bool = False
    merge_by_hash: bool = True

    def __post_init__(self):
        _require(self.mode in ("lossless", "lossy"), f"mode {self.mode!r}")
        _require(self.output in ("standalone", "embedded"), f"output {self.output!r}")
        _require(0 <= self.dpi <= 100_000, "dpi must be between 0 and 100000")
        _require(0.4 <= self.symbol_threshold <= 0.98, "symbol_threshold must be between 0.4 and 0.98")
        _require(0 <= self.symbol_weight <= 1, "symbol_weight must be between 0 and 1")

    @property
    def full(self) -> bool:
        return self.output == "standalone"


def check_raster(width: int, height: int, stride: int, layout: str, size: int) -> None:
    """The rules for an interleaved pixel buffer; trailing padding of the last row may be missing."""
    layout = PREMULTIPLIED.get(layout, layout)
    _require(layout in LAYOUTS, f"layout {layout!r}")
    _require(width > 0 and height > 0, "a raster must have a positive size")
    _require(width * height < 1 << 31, "raster too large")
    _require(stride >= width * LAYOUTS[layout], "stride is shorter than a row")
    _require(size >= stride * (height - 1) + width * LAYOUTS[layout], "pixel buffer is too short")


def check_bitmap(width: int, height: int) -> None:
    _require(width > 0 and height > 0, "a bitmap must have a positive size")
    _require(-(-width // 32) * height <= MOST_WORDS, "bitmap too large")
