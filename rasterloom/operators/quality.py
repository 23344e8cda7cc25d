"""Radiometric agreement of overlapping scenes: moments, ADM, ADSD, CD, GL and what is made of them.

All plans take overlap sides (i, j, side, band, v; see overlap.sides) and may carry extra grouping
columns in `by`, such as a method's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import divide

BINS = 256


def _on(side: str, value: str = "v"):  # noqa: ANN202
    return F.when(F.col("side") == side, F.col(value))


def pair_moments(sides: DataFrame, *by: str) -> DataFrame:
    """by, i, j, band: mean, population deviation, valid count and extent of either side, in one pass.

    An empty side has nulls.  lo and hi span both sides.
    """
    aggs = []
    for s in "ij":
        aggs += [F.avg(_on(s)).alias(f"mu_{s}"), F.stddev_pop(_on(s)).alias(f"sd_{s}"), F.count(_on(s)).alias(f"n_{s}")]
    return sides.groupBy(*by, "i", "j", "band").agg(*aggs, F.min("v").alias("lo"), F.max("v").alias("hi"))


def solver_moments(moments: DataFrame, overlaps: DataFrame) -> DataFrame:
    """What the global solver weighs: zeros where either side is empty, and the window's area, not the valid count."""
    full = moments.join(overlaps.select("i", "j", "px"), ["i", "j"])
    both = (F.col("n_i") > 0) & (F.col("n_j") > 0)
    return full.select("i", "j", "band", *[F.when(both, F.col(c)).otherwise(0.0).alias(c) for c in ("mu_i", "mu_j", "sd_i", "sd_j")], "px")


def pair_cd(sides: DataFrame, moments: DataFrame, *by: str, bins: int = BINS) -> DataFrame:
    """by, i, j, band, cd: half the summed difference of the two sides' histograms on their joint range.

    The last bin is closed; a flat range or a side under two pixels gives 0.
    """
    key = [*by, "i", "j", "band"]
    ranged = sides.filter("v IS NOT NULL").join(moments.select(*key, "lo", "hi", "n_i", "n_j"), key)
    b = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins))
    counts = ranged.groupBy(*key, b.alias("bin"), "n_i", "n_j").agg(F.count(_on("i")).alias("ci"), F.count(_on("j")).alias("cj"))
    gap = F.abs(divide(F.col("ci"), F.col("n_i").cast("double")) - divide(F.col("cj"), F.col("n_j").cast("double")))
    held = (F.min("n_i") >= 2) & (F.min("n_j") >= 2) & (F.count("bin") > 0)
    return counts.groupBy(*key).agg(F.when(held, F.sum(gap) / 2).otherwise(0.0).alias("cd"))


def per_pair_band(sides: DataFrame, *by: str) -> DataFrame:
    """by, i, j, band: adm, adsd, cd, rdoa and counts; skipped_reason where a side has no valid pixel."""
    moments = pair_moments(sides, *by)
    key = [*by, "i", "j", "band"]
    both = moments.join(pair_cd(sides, moments, *by), key, "left")
    ok = (F.col("n_i") > 0) & (F.col("n_j") > 0)
    out = both.select(*key, "n_i", "n_j", F.abs(F.col("mu_i") - F.col("mu_j")).alias("adm"), F.abs(F.col("sd_i") - F.col("sd_j")).alias("adsd"), F.when(ok, F.coalesce("cd", F.lit(0.0))).alias("cd"))
    return out.withColumns({"rdoa": (F.col("adm") + F.col("adsd") + F.col("cd")) / 3, "skipped_reason": F.when(~ok, F.lit("no valid overlap pixels"))})


def per_band(pair_band: DataFrame, *by: str) -> DataFrame:
    """by, band: ADM and ADSD as means over pairs, CD weighted by the pairs' pixels."""
    weight = F.col("n_i") + F.col("n_j")
    used = pair_band.filter("skipped_reason IS NULL")
    # A pair with under two pixels on a side adds nothing to the sum, yet its pixels count in the total.
    cd = divide(F.sum(weight * F.when((F.col("n_i") >= 2) & (F.col("n_j") >= 2), F.col("cd")).otherwise(0.0)), F.sum(weight).cast("double"))
    return used.groupBy(*by, "band").agg(F.avg("adm").alias("adm"), F.avg("adsd").alias("adsd"), cd.alias("cd"), F.count(F.lit(1)).alias("pairs"))


def per_pair(pair_band: DataFrame, *by: str) -> DataFrame:
    """by, i, j: means over bands, and a map of the bands' own values."""
    entry = F.struct(F.col("band"), F.struct("adm", "adsd", "cd").alias("m"))
    return pair_band.groupBy(*by, "i", "j").agg(
        F.avg("adm").alias("adm"), F.avg("adsd").alias("adsd"), F.avg("cd").alias("cd"), F.count("adm").alias("bands"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("skipped_reason").isNull(), entry)))).alias("per_band"),
    )


def summary(pair_band: DataFrame, n_bands: int, *by: str) -> DataFrame:
    """by: adm, adsd (over all bands asked for, empty ones as 0), cd (over bands with pixels), rdoa."""
    bands = per_band(pair_band, *by)
    out = bands.groupBy(*by).agg((F.sum("adm") / n_bands).alias("adm"), (F.sum("adsd") / n_bands).alias("adsd"), F.avg("cd").alias("cd"))
    return out.withColumn("rdoa", (F.col("adm") + F.col("adsd") + F.col("cd")) / 3)


def with_ave(summary: DataFrame, gl: DataFrame, *by: str) -> DataFrame:
    """The summary with gl and ave, the mean of adm, adsd, cd and gl."""
    out = summary.join(gl, list(by), "left") if by else summary.join(F.broadcast(gl))  # without by, gl is one row
    return out.withColumn("ave", (F.col("adm") + F.col("adsd") + F.col("cd") + F.col("gl")) / 4)


def joint_stats(joint: DataFrame) -> DataFrame:
    """i, j, band: mean and deviation of either side over pixels that are valid on both."""
    both = joint.filter("vi IS NOT NULL AND vj IS NOT NULL")
    return both.groupBy("i", "j", "band").agg(F.avg("vi").alias("mu_i"), F.stddev_pop("vi").alias("sd_i"), F.avg("vj").alias("mu_j"), F.stddev_pop("vj").alias("sd_j"), F.count(F.lit(1)).alias("n"))


def bands_with_overlap(sides: DataFrame) -> DataFrame:
    """band: those in which some pair has a valid pixel on both sides."""
    seen = sides.groupBy("i", "j", "band").agg((F.count(_on("i")) > 0).alias("si"), (F.count(_on("j")) > 0).alias("sj"))
    return seen.filter("si AND sj").select("band").distinct()


def data_quality(raw: DataFrame, *by: str) -> DataFrame:
    """by, scene_id of unconverted pixels (v may be NaN, infinite or nodata): counts, and whether all is finite."""
    v, nodata = F.col("v"), F.col("nodata")
    bad_nan, bad_inf = F.count_if(F.isnan(v)), F.count_if(F.abs(v) == float("inf"))
    out = raw.groupBy(*by, "scene_id").agg(bad_nan.alias("n_nan"), bad_inf.alias("n_inf"), F.count_if(v == nodata).alias("n_nodata"), F.count_if(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (nodata.isNull() | (v != nodata))).alias("n_valid"))
    return out.withColumn("passed", (F.col("n_nan") == 0) & (F.col("n_inf") == 0))


def pivoted(long: DataFrame, methods: list[str]) -> DataFrame:
    """method, name, value to a row a metric and a column a method."""
    return long.groupBy("name").pivot("method", methods).agg(F.first("value"))


def long_form(summary: DataFrame, *names: str) -> DataFrame:
    """method, name, value."""
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return summary.select("method", F.expr(f"stack({len(names)}, {pairs}) AS (name, value)"))


def best_of(runs: DataFrame, param: str, metric: str = "ave", *by: str) -> DataFrame:
    """by, param's value of the least metric, and the metric's least, greatest and mean: a sensitivity sweep's report."""
    return runs.groupBy(*by).agg(F.min_by(param, F.struct(metric, param)).alias("best"), F.min(metric).alias("least"), F.max(metric).alias("greatest"), F.avg(metric).alias("mean"))
