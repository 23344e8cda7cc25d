"""Quality along the middle seams of all overlaps and bands at once, from aligned pixels (i, j, band, r, c, vi, vj).

Each overlap's seam runs down its middle column: scene i lies before it, scene j from it on.  A line of an
overlap and band is one group; all measures that look at a few columns come from one shuffle of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import small
from . import seams

PAIR = ("i", "j")
LINE = (*PAIR, "band", "r")


def middles(overlaps: DataFrame) -> DataFrame:
    """i, j, n, sc, rows: each overlap's columns, seam column and lines."""
    n = F.col("i_c1") - F.col("i_c0")
    return overlaps.select(*PAIR, n.alias("n"), F.floor(n / 2).cast("int").alias("sc"), (F.col("i_r1") - F.col("i_r0")).alias("rows"))


def _beside(aligned: DataFrame, lines: DataFrame) -> DataFrame:
    return aligned.join(small(lines), list(PAIR)).withColumn("d", F.col("c") - F.col("sc"))


def steps(aligned: DataFrame, lines: DataFrame, strip: int = 10) -> DataFrame:
    """i, j, band, r: jump (|mean of the strip before the seam in i - mean of the strip from it on in j|, null where a strip doesn't fit), gap (how unlike the steps on either side are), before and after (the pixels next to the seam, in i and j)."""
    reach = max(strip, 2)
    near = _beside(aligned, lines).filter((F.col("d") >= -reach) & (F.col("d") < reach))
    at = lambda v, k: F.max(F.when(F.col("d") == k, F.col(v)))
    left = F.avg(F.when((F.col("d") < 0) & (F.col("d") >= -strip), F.col("vi")))
    right = F.avg(F.when((F.col("d") >= 0) & (F.col("d") < strip), F.col("vj")))
    fits = (F.first("sc") >= strip) & (F.first("sc") + strip < F.first("n"))
    gap = F.abs(F.abs(at("vi", 0) - at("vi", -1)) - F.abs(at("vj", 1) - at("vj", 0)))
    return near.groupBy(*LINE).agg(F.when(fits, F.abs(left - right)).alias("jump"), gap.alias("gap"), at("vi", -1).alias("before"), at("vj", 1).alias("after"))


def colours(made: DataFrame) -> DataFrame:
    """i, j, r, colour: the distance over all bands of the pixels next to the seam, of lines whose bands are all valid; made by steps."""
    whole = F.bool_and(F.col("before").isNotNull() & F.col("after").isNotNull())
    return made.groupBy(*PAIR, "r").agg(F.when(whole, F.sqrt(F.sum((F.col("before") - F.col("after")) ** 2))).alias("colour"))


def transitions(aligned: DataFrame, lines: DataFrame, share: float = 0.1) -> DataFrame:
    """i, j, band, r, width: how many pixels of i around the seam keep a gradient of at least share of the line's peak within half the overlap; invalid pixels count as the overlap's mean."""
    means = aligned.groupBy(*PAIR, "band").agg(F.avg("vi").alias("mean"))
    along, line = W.partitionBy(*LINE).orderBy("c"), W.partitionBy(*LINE)
    full = _beside(aligned, lines).join(small(means), [*PAIR, "band"]).withColumn("f", F.coalesce("vi", "mean"))
    steep = full.withColumn("g", F.abs(F.lead("f").over(along) - F.lag("f").over(along)) / 2)
    near = steep.filter("g IS NOT NULL AND abs(d) <= floor(n / 2)").withColumn("low", F.col("g") < share * F.max("g").over(line))
    first = near.groupBy(*LINE).agg(F.min(F.when(F.col("low") & (F.col("d") >= 0), F.col("d"))).alias("right"), F.max(F.when(F.col("low") & (F.col("d") < 0), F.col("d"))).alias("left"), F.max("d").alias("dr"), F.min("d").alias("dl"))
    return first.select(*LINE, (F.coalesce("right", F.col("dr") + 1) - F.coalesce("left", F.col("dl") - 1) - 1).alias("width"))


def reports(aligned: DataFrame, overlaps: DataFrame, strip: int = 10) -> DataFrame:
    """i, j, band, measure, mean, median, p95, greatest, n: jump, gap and transition of each overlap and band, colour of each overlap (band null)."""
    lines = middles(overlaps)
    made = steps(aligned, lines, strip)
    each = made.select(*PAIR, "band", F.explode(F.create_map(F.lit("jump"), F.col("jump"), F.lit("gap"), F.col("gap"))).alias("measure", "x"))
    each = each.unionByName(colours(made).select(*PAIR, F.lit(None).cast("int").alias("band"), F.lit("colour").alias("measure"), F.col("colour").alias("x")))
    each = each.unionByName(transitions(aligned, lines).select(*PAIR, "band", F.lit("transition").alias("measure"), F.col("width").cast("double").alias("x")))
    return seams.reported(each.filter("x IS NOT NULL"), "x", *PAIR, "band", "measure")


def blended(aligned: DataFrame, lines: DataFrame, widths: list[int]) -> DataFrame:
    """i, j, band, width, r, c, d, v: i blended into j linearly over each width around the seam; one side alone where the other is invalid."""
    spread = _beside(aligned, lines).withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    wb = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("d") / (2.0 * F.col("width"))))
    mixed = (1 - wb) * F.col("vi") + wb * F.col("vj")
    return spread.select(*PAIR, "band", "width", "r", "c", "d", F.coalesce(mixed, "vi", "vj").alias("v"))


def sweep(aligned: DataFrame, overlaps: DataFrame, widths: list[int]) -> DataFrame:
    """i, j, band, width, mean, sd, n of the blended values."""
    return blended(aligned, middles(overlaps), widths).groupBy(*PAIR, "band", "width").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))
