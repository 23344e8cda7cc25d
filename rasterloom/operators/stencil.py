"""Neighbourhood operators on dense grids (scene_id, band, row, col, v).

Radius-1 stencils are window functions: one pass along rows and one along columns, each partitioned
by scene, band and line, so a scene of any size spreads over its lines; groups may have any columns.
Borders repeat the edge pixel.  Wider kernels cut the pixels into tiles (tiles.py), which has the
radius-1 stencils of tiled rasters too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tiles

LINE, COLUMN = ("row", "col"), ("col", "row")


def _near(v: Column, axis: tuple[str, str], by: list[str]) -> tuple[Column, Column]:
    """The neighbours before and after along an axis, the pixel itself at a border."""
    w = W.partitionBy(*by, axis[0]).orderBy(axis[1])
    return F.lag(v).over(w), F.lead(v).over(w)


def _edge(v: Column, axis: tuple[str, str], by: list[str]) -> tuple[Column, Column]:
    before, after = _near(v, axis, by)
    return F.coalesce(before, v), F.coalesce(after, v)


def sobel(grid: DataFrame, value: str = "v", by: tuple[str, ...] = ("scene_id", "band"), fill: float = 0.0) -> DataFrame:
    """grid with gx and gy: 3 x 3 Sobel, invalid pixels as fill, borders repeated."""
    by = list(by)
    v = F.coalesce(F.col(value), F.lit(fill))
    left, right = _edge(v, LINE, by)
    one = grid.withColumns({"_dx": right - left, "_sx": left + 2 * v + right})
    up_d, down_d = _edge(F.col("_dx"), COLUMN, by)
    up_s, down_s = _edge(F.col("_sx"), COLUMN, by)
    return one.withColumns({"gx": up_d + 2 * F.col("_dx") + down_d, "gy": down_s - up_s}).drop("_dx", "_sx")


def orientation(grid: DataFrame, value: str = "v", by: tuple[str, ...] = ("scene_id", "band")) -> DataFrame:
    """grid with theta = atan2(|gy|, |gx|)."""
    return sobel(grid, value, by).withColumn("theta", F.atan2(F.abs("gy"), F.abs("gx"))).drop("gx", "gy")


def gl(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """by: gl, the mean over bands of the mean over scenes of the mean change in orientation on pixels valid in both.

    before has no columns by: each group of after is held against it.
    """
    key = ["scene_id", "band", "row", "col"]
    a = orientation(before).select(*key, F.col("v").alias("v0"), F.col("theta").alias("t0"))
    b = orientation(after, by=(*by, "scene_id", "band")).select(*by, *key, F.col("v").alias("v1"), F.col("theta").alias("t1"))
    both = b.join(a, key).filter("v0 IS NOT NULL AND v1 IS NOT NULL")
    scenes = both.groupBy(*by, "band", "scene_id").agg(F.avg(F.abs(F.col("t1") - F.col("t0"))).alias("d"))
    return scenes.groupBy(*by, "band").agg(F.avg("d").alias("d")).groupBy(*by).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("gl"))


def filled_with_mean(grid: DataFrame, by: tuple[str, ...] = ("scene_id", "band")) -> DataFrame:
    """grid with f: invalid pixels as the group's mean.  The means are aggregated, then joined (broadcast at run time where they turn out small), so no group gathers in one task."""
    means = grid.groupBy(*by).agg(F.avg("v").alias("_m"))
    return grid.join(means, list(by)).withColumn("f", F.coalesce("v", "_m")).drop("_m")


def sharpness(grid: DataFrame, method: str = "tenengrad", by: tuple[str, ...] = ("scene_id", "band")) -> DataFrame:
    """by, sharpness: mean squared Sobel gradient, or the variance of the 4-neighbour Laplacian."""
    full = filled_with_mean(grid, by)
    if method == "tenengrad":
        return sobel(full, "f", by).groupBy(*by).agg(F.avg(F.col("gx") ** 2 + F.col("gy") ** 2).alias("sharpness"))
    if method != "laplacian":
        raise ValueError(f"unknown sharpness method {method!r}")
    left, right = _edge(F.col("f"), LINE, list(by))
    up, down = _edge(F.col("f"), COLUMN, list(by))
    return full.withColumn("lap", left + right + up + down - 4 * F.col("f")).groupBy(*by).agg(F.var_pop("lap").alias("sharpness"))


def sharpness_retention(before: DataFrame, after: DataFrame, method: str = "tenengrad") -> DataFrame:
    """scene_id, band, retention: sharpness after over sharpness before, null if that was 0."""
    b, a = (sharpness(x, method).withColumnRenamed("sharpness", n) for x, n in ((before, "s0"), (after, "s1")))
    return b.join(a, ["scene_id", "band"]).select("scene_id", "band", (F.col("s1") / F.nullif("s0", F.lit(0.0))).alias("retention"))


def gradient_energy(grid: DataFrame, by: tuple[str, ...] = ("scene_id", "band")) -> DataFrame:
    """by, energy: the sum of squared Sobel gradients with zeros beyond the border."""
    v = F.coalesce(F.col("v"), F.lit(0.0))
    left, right = (F.coalesce(x, F.lit(0.0)) for x in _near(v, LINE, list(by)))
    one = grid.withColumns({"_dx": right - left, "_sx": left + 2 * v + right})
    (up_d, down_d), (up_s, down_s) = (tuple(F.coalesce(x, F.lit(0.0)) for x in _near(F.col(c), COLUMN, list(by))) for c in ("_dx", "_sx"))
    g = one.withColumns({"gx": up_d + 2 * F.col("_dx") + down_d, "gy": down_s - up_s})
    return g.groupBy(*by).agg(F.sum(F.col("gx") ** 2 + F.col("gy") ** 2).alias("energy"))


def box_std(grid: DataFrame, size: int = 7, tile: int = tiles.SIZE) -> DataFrame:
    """scene_id, band, row, col, v, sd: the deviation in a size x size box, invalid pixels as the mean, borders mirrored.  Pixels are cut into tiles."""
    return tiles.pixels(tiles.box_std(tiles.cut(grid, tile), size), v="v", sd="sd")


def texture_loss(before: DataFrame, after: DataFrame, zone: DataFrame, size: int = 7, tile: int = tiles.SIZE) -> DataFrame:
    """scene_id, band, loss: 1 - mean local deviation after / before, over the pixels of zone (scene_id, row, col)."""
    key = ["scene_id", "band"]
    means = []
    for x, n in ((before, "s0"), (after, "s1")):
        sd = box_std(x, size, tile).filter("v IS NOT NULL").join(zone, ["scene_id", "row", "col"], "left_semi")
        means.append(sd.groupBy(*key).agg(F.avg("sd").alias(n)))
    return means[0].join(means[1], key).select(*key, (1 - F.col("s1") / F.nullif("s0", F.lit(0.0))).alias("loss"))
