"""Robust statistics, local over-enhancement, coefficient and displacement diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import is_valid, percentiles, small
from .stencil import gradient_energy


def described(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by: n, min, max, mean, sd and percentiles of the finite values."""
    q = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    rows = df.filter(is_valid(F.col(value)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), percentiles(value, *q).alias("q"))
    return out.select(*by, "n", "min", "max", "mean", "sd", *[F.get("q", F.lit(k)).alias(f"p{int(x * 100):02d}") for k, x in enumerate(q)])


def _beside(df: DataFrame, groups: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """df with its group's row; without by that is one row, else the runtime plan broadcasts the groups only if they turn out small."""
    return df.join(groups, list(by)) if by else df.join(F.broadcast(groups))


def mad(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, med, mad: the median, and the median distance from it; 0 for under two values."""
    med = df.groupBy(*by).agg(percentiles(value, 0.5).alias("med"), F.count(value).alias("n"))
    far = _beside(df, med, by)
    out = far.groupBy(*by).agg(F.first("med").alias("med"), percentiles(F.abs(F.col(value) - F.col("med")), 0.5).alias("mad"), F.first("n").alias("n"))
    return out.select(*by, "med", F.when(F.col("n") < 2, 0.0).otherwise(F.col("mad")).alias("mad"))


def robust_z(df: DataFrame, value: str, *by: str) -> DataFrame:
    """df with z = (x - median) / (1.4826 MAD), 0 where the MAD is nothing."""
    centre = mad(df, value, *by)
    both = _beside(df, centre, by)
    return both.withColumn("z", F.when(F.col("mad") < 1e-12, 0.0).otherwise((F.col(value) - F.col("med")) / (1.4826 * F.col("mad")))).drop("med", "mad")


def mad_inliers(points: DataFrame, norm: str, *by: str) -> DataFrame:
    """Points whose norm is at most the median plus three MADs."""
    centre = mad(points, norm, *by)
    both = _beside(points, centre, by)
    return both.filter(F.col(norm) <= F.col("med") + 3 * F.col("mad")).drop("med", "mad")


def joint_inliers(points: DataFrame, x: str, y: str, *by: str, floor: float = 0.3) -> DataFrame:
    """Points within max(3 MAD, floor) of the median on both axes."""
    out = points
    for c in (x, y):
        centre = mad(points, c, *by).withColumnsRenamed({"med": f"_med_{c}", "mad": f"_mad_{c}"})
        out = _beside(out, centre, by)
    near = [F.abs(F.col(c) - F.col(f"_med_{c}")) < F.greatest(3 * F.col(f"_mad_{c}"), F.lit(floor)) for c in (x, y)]
    return out.filter(near[0] & near[1]).select(*points.columns)


def overenhanced(before: DataFrame, after: DataFrame, block: int, std_limit: float = 1.5, energy_limit: float = 2.0, least: int = 10) -> DataFrame:
    """scene_id, band, bm, bn: blocks of at least 10 valid pixels with the ratios of deviation and gradient energy, and whether either is over its limit."""
    key = ["scene_id", "band", "bm", "bn"]
    cut = lambda x: x.withColumns({"bm": F.floor(F.col("row") / block), "bn": F.floor(F.col("col") / block)})
    parts = []
    for x, n in ((before, "0"), (after, "1")):
        blocks = cut(x)
        sd = blocks.groupBy(*key).agg(F.stddev_pop("v").alias(f"sd{n}"), F.count("v").alias(f"n{n}"))
        parts.append(sd.join(gradient_energy(blocks, tuple(key)).withColumnRenamed("energy", f"e{n}"), key))
    both = parts[0].join(parts[1], key).filter(f"n0 >= {least} AND n1 >= {least}")
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    out = both.select(*key, ratio("sd1", "sd0").alias("std_ratio"), ratio("e1", "e0").alias("energy_ratio"))
    return out.withColumn("flagged", F.coalesce(F.col("std_ratio") > std_limit, F.lit(False)) | F.coalesce(F.col("energy_ratio") > energy_limit, F.lit(False)))


def saturation_change(before: DataFrame, after: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """scene_id, band, change: the share of pixels below low or above high, after minus before."""
    share = lambda x, n: x.filter("v IS NOT NULL").groupBy("scene_id", "band").agg(F.avg(((F.col("v") < low) | (F.col("v") > high)).cast("double")).alias(n))
    return share(before, "s0").join(share(after, "s1"), ["scene_id", "band"]).select("scene_id", "band", (F.col("s1") - F.col("s0")).alias("change"))


def coefficient_report(coef: DataFrame) -> DataFrame:
    """band: means and deviations of a and b, outliers of |robust z| > 3, and the root mean square of a - 1."""
    z = robust_z(robust_z(coef, "a", "band").withColumnRenamed("z", "za"), "b", "band").withColumnRenamed("z", "zb")
    out = F.count_if((F.abs("za") > 3) | (F.abs("zb") > 3)).alias("outliers")
    return z.groupBy("band").agg(F.avg("a").alias("mean_a"), F.stddev_pop("a").alias("sd_a"), F.avg("b").alias("mean_b"), F.stddev_pop("b").alias("sd_b"), out, F.sqrt(F.avg((F.col("a") - 1) ** 2)).alias("rms_a"))


def coefficient_outliers(coef: DataFrame, blocks: DataFrame) -> DataFrame:
    """Outlying blocks with their centres, for a map."""
    z = robust_z(coef, "a", "band").filter("abs(z) > 3")
    return z.join(blocks.select("block_id", "cx", "cy"), "block_id").select("band", "block_id", "a", "b", "z", "cx", "cy")


def neighbour_steps(coef: DataFrame, blocks: DataFrame) -> DataFrame:
    """band: mean and greatest |a - a'| between blocks one cell apart in either direction or both, of any scenes.

    An equi join: each block is listed under the nine cells around it.
    """
    placed = coef.join(blocks.select("block_id", "gm", "gn"), "block_id")
    near = placed.select("band", "block_id", "a", "gm", "gn", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dm")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dn"))
    near = near.filter("dm <> 0 OR dn <> 0").select("band", F.col("block_id").alias("other"), F.col("a").alias("a2"), (F.col("gm") + F.col("dm")).alias("gm"), (F.col("gn") + F.col("dn")).alias("gn"))
    met = placed.join(near, ["band", "gm", "gn"]).filter("block_id < other")
    return met.groupBy("band").agg(F.avg(F.abs(F.col("a") - F.col("a2"))).alias("mean_step"), F.max(F.abs(F.col("a") - F.col("a2"))).alias("greatest_step"), F.count(F.lit(1)).alias("n"))


def field_stats(field: DataFrame, clip: float | None = None) -> DataFrame:
    """scene_id: statistics of a displacement field (scene_id, row, col, dx, dy) over its non-zero cells, of its central differences, and how many cells reach the clip."""
    along = W.partitionBy("scene_id", "row").orderBy("col")
    down = W.partitionBy("scene_id", "col").orderBy("row")
    diff = lambda c, w: (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))) / (F.lead(c).over(w).isNotNull().cast("int") + F.lag(c).over(w).isNotNull().cast("int"))
    steep = field.withColumn("g", F.sqrt(sum(F.coalesce(diff(c, w), F.lit(0.0)) ** 2 for c in ("dx", "dy") for w in (along, down))))
    size = F.hypot("dx", "dy")
    on = F.when((F.col("dx") != 0) | (F.col("dy") != 0), size)
    clipped = F.count_if((F.abs("dx") >= clip) | (F.abs("dy") >= clip)) if clip is not None else F.lit(None).cast("long")
    return steep.groupBy("scene_id").agg(F.avg(on).alias("mean"), F.max(on).alias("greatest"), percentiles(on, 0.95).alias("p95"), F.count(on).alias("n"), F.avg("g").alias("mean_gradient"), F.max("g").alias("greatest_gradient"), clipped.alias("clipped"))


def nearest_control(points: DataFrame, cell: float) -> DataFrame:
    """scene_id, point_id, nn: each control point's distance to the nearest other within a cell's reach, null beyond it."""
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    placed = points.withColumns({"gx": at("x"), "gy": at("y")})
    steps = F.sequence(F.lit(-1), F.lit(1))
    spread = placed.select("scene_id", F.col("point_id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), "gx", "gy", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    spread = spread.select("scene_id", "q", "qx", "qy", (F.col("gx") + F.col("i")).alias("gx"), (F.col("gy") + F.col("j")).alias("gy"))
    met = placed.join(spread, ["scene_id", "gx", "gy"]).filter("point_id <> q").withColumn("d", F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))).filter(F.col("d") <= cell)
    least = met.groupBy("scene_id", "point_id").agg(F.min("d").alias("nn"))
    return points.select("scene_id", "point_id").join(least, ["scene_id", "point_id"], "left")


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners in order around the hull of a few points."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def chain(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def spikes(field: DataFrame, floor: float = 0.05, top: int = 200) -> DataFrame:
    """scene_id, row, col, g, rank: cells whose gradient is over max(median + 6 MAD, p99, floor), the steepest first; a report of the top ones."""
    along, down = W.partitionBy("scene_id", "row").orderBy("col"), W.partitionBy("scene_id", "col").orderBy("row")
    half = lambda c, w: (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))) / 2
    steep = field.withColumn("g", F.sqrt(sum(half(c, w) ** 2 for c in ("dx", "dy") for w in (along, down)))).select("scene_id", "row", "col", "g")
    limits = mad(steep, "g", "scene_id").join(steep.groupBy("scene_id").agg(percentiles("g", 0.99).alias("p99")), "scene_id")
    over = steep.join(small(limits), "scene_id").filter(F.col("g") > F.greatest(F.col("med") + 6 * F.col("mad"), "p99", F.lit(floor)))
    return over.withColumn("rank", F.row_number().over(W.partitionBy("scene_id").orderBy(F.col("g").desc(), "row", "col"))).filter(F.col("rank") <= top).select("scene_id", "row", "col", "g", "rank")
