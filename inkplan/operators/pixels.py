"""Gray pages as relations of pixels (page_no, x, y, g): dilation, background tiles, cleaning, threshold, upsampling.

Windows and aggregates are partitioned by page and row or column, or by tile, so no page meets in one task. Every column
named in `by` tells pages apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkplan.functions import scalar
from inkplan.functions.raster import GROW, INK, LEAST, PAPER, REACH_X, REACH_Y, TILE_X, TILE_Y

_BY = ["page_no"]


def gray_of(pixels: DataFrame, layout: str, how: str = "luma") -> DataFrame:
    """Replaces the channel columns r, gr, b, a (those that the layout has) by g."""
    if layout in ("Gray8", "GrayAlpha16"):
        level = F.col("gr").cast("long")
    else:
        level = scalar.luma("r", "gr", "b") if how == "luma" else F.col("gr").cast("long")
    if layout in ("GrayAlpha16", "Rgba32", "Bgra32"):
        level = scalar.over_white(level, F.col("a"))
    return pixels.withColumn("g", level).drop("r", "gr", "b", "a")


def threshold(pixels: DataFrame, limit: int) -> DataFrame:
    return pixels.withColumn("ink", (F.col("g") < limit).cast("long")).drop("g")


def dilated(pixels: DataFrame, by: list[str] = _BY) -> DataFrame:
    """Adds near_ink: whether ink (a level under INK) is within a square of GROW pixels to each side. Rows, then columns."""
    across = Window.partitionBy(*by, "y").orderBy("x").rowsBetween(-GROW, GROW)
    down = Window.partitionBy(*by, "x").orderBy("y").rowsBetween(-GROW, GROW)
    return pixels.withColumn("near_ink", F.max((F.col("g") < INK).cast("long")).over(across)).withColumn("near_ink", F.max("near_ink").over(down))


def sizes(pixels: DataFrame, by: list[str] = _BY) -> DataFrame:
    return pixels.groupBy(*by).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def background_tiles(pixels: DataFrame, by: list[str] = _BY) -> DataFrame:
    """Pages by tile (tx, ty) with level: mean of the pixels away from ink in complete tiles, null where too few are."""
    tile = dilated(pixels, by).withColumn("tx", scalar.div(F.col("x"), TILE_X)).withColumn("ty", scalar.div(F.col("y"), TILE_Y))
    paper = F.col("near_ink") == 0
    means = tile.groupBy(*by, "tx", "ty").agg(F.count("*").alias("n"), F.sum(F.when(paper, F.col("g"))).alias("s"), F.count(F.when(paper, 1)).alias("c"))
    return means.select(*by, "tx", "ty", F.when((F.col("n") == TILE_X * TILE_Y) & (F.col("c") >= LEAST), scalar.div(F.col("s"), F.col("c"))).alias("level"))


def filled_tiles(tiles: DataFrame, by: list[str] = _BY) -> DataFrame:
    """Holes closed from above, else from below; whole columns from the left, else from the right. Pages without any level keep nulls."""
    column = Window.partitionBy(*by, "tx").orderBy("ty")
    row = Window.partitionBy(*by, "ty").orderBy("tx")
    after = lambda w: w.rowsBetween(0, Window.unboundedFollowing)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    closed = lambda w: F.coalesce(F.last("level", ignorenulls=True).over(before(w)), F.first("level", ignorenulls=True).over(after(w)))
    return tiles.withColumn("level", closed(column)).withColumn("level", closed(row))


def inverse_tiles(tiles: DataFrame, by: list[str] = _BY) -> DataFrame:
    """factor of each tile: paper over its level smoothed by a box that is clipped at the edges."""
    across = Window.partitionBy(*by, "ty").orderBy("tx").rowsBetween(-REACH_X, REACH_X)
    down = Window.partitionBy(*by, "tx").orderBy("ty").rowsBetween(-REACH_Y, REACH_Y)
    summed = tiles.withColumn("s", F.sum("level").over(across)).withColumn("n", F.count("*").over(across)).withColumn("s", F.sum("s").over(down)).withColumn("n", F.sum("n").over(down))
    mean = scalar.div(F.col("s") + scalar.div(F.col("n"), 2), F.col("n"))
    return summed.withColumn("mean", mean).select(*by, "tx", "ty", F.when(F.col("mean") > 0, scalar.div(F.lit(256 * PAPER).cast("long"), F.col("mean"))).otherwise(PAPER // 2).alias("factor"))


def background_applied(pixels: DataFrame, by: list[str] = _BY) -> DataFrame:
    """g scaled by its tile's factor; pages under five tiles to a side, or without any level, stay as they are."""
    large = sizes(pixels, by).where((F.col("w") > 4 * TILE_X) & (F.col("h") > 4 * TILE_Y)).select(*by)
    tiles = inverse_tiles(filled_tiles(background_tiles(pixels, by), by).where("level is not null"), by).join(large, by, "left_semi")
    keyed = pixels.withColumn("tx", scalar.div(F.col("x"), TILE_X)).withColumn("ty", scalar.div(F.col("y"), TILE_Y))
    scaled = F.least(F.lit(255).cast("long"), F.shiftright(F.col("g") * F.col("factor"), 8))
    return keyed.join(tiles, [*by, "tx", "ty"], "left").withColumn("g", F.when(F.col("factor").isNull(), F.col("g")).otherwise(scaled)).drop("tx", "ty", "factor")


def cleaned(pixels: DataFrame, gamma: float = 1.0, black: int = 90, white: int = 190, by: list[str] = _BY) -> DataFrame:
    """Background to white, then the contrast curve. A white level over PAPER is taken as 190."""
    return background_applied(pixels, by).withColumn("g", scalar.gamma_level("g", gamma, black, 190 if white > PAPER else white))


def upsampled(pixels: DataFrame, factor: int, by: list[str] = _BY) -> DataFrame:
    """factor times as many pixels each way; v is the level times 256, drawn towards the right and lower neighbour."""
    right = Window.partitionBy(*by, "y").orderBy("x")
    below = Window.partitionBy(*by, "x").orderBy("y")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(factor - 1).cast("long")))
    wide = pixels.withColumn("b", F.coalesce(F.lead("g").over(right), F.col("g"))).withColumn("k", steps)
    wide = wide.select(*by, (F.col("x") * factor + F.col("k")).alias("x"), "y", scalar.div(((factor - F.col("k")) * F.col("g") + F.col("k") * F.col("b")) * 256, factor).alias("v"))
    tall = wide.withColumn("u", F.coalesce(F.lead("v").over(below), F.col("v"))).withColumn("k", steps)
    return tall.select(*by, "x", (F.col("y") * factor + F.col("k")).alias("y"), scalar.div((factor - F.col("k")) * F.col("v") + F.col("k") * F.col("u"), factor).alias("v"))
