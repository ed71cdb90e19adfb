"""Scalar column functions of the imaging engine; all are built-in Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkplan.plans.options import LAYOUTS


def _long(x) -> Column:
    return (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)).cast("long")


def div(a: Column, b) -> Column:
    """Truncating integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def bytes_per_pixel(layout: Column) -> Column:
    """Bytes per pixel; an unknown layout fails the query."""
    known = reduce(lambda c, kv: c.when(layout == kv[0], F.lit(kv[1])), list(LAYOUTS.items())[1:], F.when(layout == "Gray8", F.lit(1)))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown pixel layout "), layout)).cast("int"))


def luma(r, g, b) -> Column:
    """ITU-R 601 weights in 16-bit fixed point, rounded."""
    return F.shiftright(_long(r) * 19595 + _long(g) * 38470 + _long(b) * 7471 + 32768, 16)


def over_white(gray, alpha) -> Column:
    """Gray composed over white paper."""
    g, a = _long(gray), _long(alpha)
    return F.when(a == 255, g).otherwise(div(g * a + (255 - a) * 255 + 127, 255))


def effective_threshold(mode: Column, threshold: Column) -> Column:
    return F.when(threshold >= 0, threshold).when(mode == "global", 128).otherwise(200)


def gamma_level(level, gamma: float, black: int, white: int) -> Column:
    """What the contrast curve makes of a gray level, in single precision."""
    i = _long(level)
    x = ((i - black).cast("float") / F.lit(float(white - black)).cast("float")).cast("float")
    curve = x if gamma == 1 else F.pow(x, F.lit(1.0 / gamma)).cast("float")
    bent = F.floor(curve.cast("double") * 255.0 + 0.5).cast("long")
    return F.when(i < black, 0).when(i > white, 255).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), bent))).cast("long")


def valid_dpi(value: Column) -> Column:
    """A resolution rounded half to even, or 0 if it is not between 1 and 99999."""
    return F.when((value >= 1) & (value < 100_000), F.bround(value).cast("long")).otherwise(0).cast("long")


def dpi_of(value: Column, unit: Column) -> Column:
    """dpi from pixels per inch, cm, m or mm; an aspect ratio, or 1 pixel per mm (unset), gives 0."""
    scaled = F.when(unit == "inch", value).when(unit == "cm", value * 2.54).when(unit == "m", value * 0.0254).when((unit == "mm") & (value != 1.0), value * 25.4).otherwise(0.0)
    return valid_dpi(scaled)


def pixels_per_metre(dpi: Column) -> Column:
    return F.when(dpi <= 0, 0).otherwise(F.bround(dpi / F.lit(0.0254)).cast("long")).cast("long")


def resolved_dpi(option: Column, bitmap: Column) -> Column:
    return F.when(option > 0, option).otherwise(bitmap)


def bits_for(count: Column) -> Column:
    """Bits that number `count` things: 0 and 1 need none."""
    return F.when(count <= 1, 0).otherwise(F.length(F.bin(count.cast("long") - 1))).cast("long")


def round_away(value: Column) -> Column:
    """Half away from zero, with the addition in single precision."""
    half = F.lit(0.5).cast("float")
    v = value.cast("float")
    return F.when(v >= 0, (v + half).cast("float").cast("int")).otherwise((v - half).cast("float").cast("int"))


def weighted_threshold(threshold: float, weight: float, area: Column, box: Column) -> Column:
    """The correlation that a template of that ink and box asks for; settings are single precision, the sum double."""
    t, w = (F.lit(x).cast("float").cast("double") for x in (threshold, weight))
    return (t + (F.lit(1.0) - t) * w * area / box).cast("float")


def word_window(words: Column, width: Column, position: Column) -> Column:
    """32 pixels from any position of a row of 32-bit words (leftmost pixel highest); outside is white."""
    at = F.floor(position / 32).cast("long")
    shift = (position - at * 32).cast("int")
    get = lambda i: F.when((i >= 0) & (i < F.size(words)), F.get(words, i.cast("int"))).otherwise(F.lit(0)).cast("long")
    both = F.expr("0L") + get(at)
    return F.when(shift == 0, both).otherwise(F.call_function("shiftleft", get(at), shift).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.call_function("shiftright", get(at + 1), F.lit(32) - shift)))


def pixel(words: Column, x: Column) -> Column:
    """A pixel of a row; outside is white."""
    word = F.get(words, F.floor(x / 32).cast("int"))
    return F.when((x >= 0) & word.isNotNull(), F.call_function("shiftright", word, (F.lit(31) - x % 32).cast("int")).bitwiseAND(F.lit(1))).otherwise(0).cast("long")


def with_pixel(words: Column, x: Column, black: Column) -> Column:
    """The row with that pixel set; a place outside changes nothing."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(31) - F.pmod(x, F.lit(32))).cast("int"))
    one = lambda w, k: F.when(k == F.floor(x / 32), F.when(black, w.bitwiseOR(bit)).otherwise(w.bitwiseAND(F.bitwise_not(bit)))).otherwise(w)
    return F.transform(words, one)


def black_count(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w).cast("long"))


def packed(bits: Column) -> Column:
    """Array of 0/1 pixels to 32-bit words, the last padded with white."""
    count = F.ceil(F.size(bits) / F.lit(32)).cast("int")
    one = lambda k: F.conv(F.rpad(F.array_join(F.slice(bits, k * 32 + 1, F.lit(32)), ""), 32, "0"), 2, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), count - 1), one)


def unpacked(words: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), width.cast("int") - 1), lambda x: pixel(words, x))
