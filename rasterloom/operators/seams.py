"""Quality along a seam: a table seam (row, sc) gives the first column of the right image in each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import percentiles, small


def jump(a: DataFrame, b: DataFrame, seam: DataFrame, strip: int, n_cols: int) -> DataFrame:
    """row, jump: |mean of the strip left of the seam in a - mean of the strip from the seam on in b|, where both strips fit."""
    fits = small(seam.filter(f"sc >= {strip} AND sc + {strip} < {n_cols}"))
    left = a.join(fits, "row").filter(f"col >= sc - {strip} AND col < sc").groupBy("row").agg(F.avg("v").alias("ml"))
    right = b.join(fits, "row").filter(f"col >= sc AND col < sc + {strip}").groupBy("row").agg(F.avg("v").alias("mr"))
    return left.join(right, "row").select("row", F.abs(F.col("ml") - F.col("mr")).alias("jump")).filter("jump IS NOT NULL")


def _at(px: DataFrame, seam: DataFrame, **offsets: int) -> DataFrame:
    """row and one column for each named offset from the seam."""
    wanted = [F.max(F.when(F.col("col") == F.col("sc") + k, F.col("v"))).alias(n) for n, k in offsets.items()]
    return px.join(small(seam), "row").filter(F.col("col").between(F.col("sc") + min(offsets.values()), F.col("sc") + max(offsets.values()))).groupBy("row").agg(*wanted)


def gradient_break(a: DataFrame, b: DataFrame, seam: DataFrame) -> DataFrame:
    """row, gap: ||a[sc] - a[sc - 1]| - |b[sc + 1] - b[sc]||."""
    both = _at(a, seam, a0=-1, a1=0).join(_at(b, seam, b0=0, b1=1), "row")
    return both.select("row", F.abs(F.abs(F.col("a1") - F.col("a0")) - F.abs(F.col("b1") - F.col("b0"))).alias("gap")).filter("gap IS NOT NULL")


def colour_distance(a: DataFrame, b: DataFrame, seam: DataFrame) -> DataFrame:
    """row, distance: Euclidean over the bands of a[sc - 1] against b[sc + 1]; rows with an invalid band are left out."""
    near, s = [], small(seam)
    for px, k, n in ((a, -1, "va"), (b, 1, "vb")):
        near.append(px.join(s, "row").filter(F.col("col") == F.col("sc") + k).select("row", "band", F.col("v").alias(n)))
    both = near[0].join(near[1], ["row", "band"])
    out = both.groupBy("row").agg(F.when(F.bool_and(F.col("va").isNotNull() & F.col("vb").isNotNull()), F.sqrt(F.sum((F.col("va") - F.col("vb")) ** 2))).alias("distance"))
    return out.filter("distance IS NOT NULL")


def reported(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by: mean, median, p95 and greatest of a per-row value, and the number of rows."""
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), percentiles(value, 0.5, 0.95).alias("q"), F.max(value).alias("greatest"), F.count(value).alias("n"))
    return out.select(*by, "mean", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p95"), "greatest", "n")


def length(mask: DataFrame, pixel: float = 1.0) -> DataFrame:
    """One row: the seam's length, its pixels times their size."""
    return mask.agg((F.count_if(F.col("on")) * pixel).alias("length"))


def transition_width(px: DataFrame, seam: DataFrame, reach: int | None = None, share: float = 0.1, farthest_peak: bool = False) -> DataFrame:
    """row, width: how many pixels on either side of the seam keep a gradient of at least share of the row's peak.

    The peak is the greatest gradient within reach of the seam, by default half the image's width; with farthest_peak it is that of the
    farthest left pixel.  Runs are gaps and islands: the count up to the first smaller gradient.
    """
    w = W.partitionBy("row").orderBy("col")
    grad = px.withColumn("g", F.abs(F.lead("v").over(w) - F.lag("v").over(w)) / 2)
    near = grad.join(small(seam), "row").withColumn("d", F.col("col") - F.col("sc"))
    half = px.agg(F.floor((F.max("col") - F.min("col") + 1) / 2).alias("most")) if reach is None else px.sparkSession.range(1).select(F.lit(reach).alias("most"))
    near = near.crossJoin(F.broadcast(half)).filter("abs(d) <= most AND g IS NOT NULL").drop("most")
    peak = F.max_by("g", -F.col("d")) if farthest_peak else F.max("g")
    held = near.join(near.groupBy("row").agg(peak.alias("peak")), "row").withColumn("low", F.col("g") < share * F.col("peak"))
    first = held.groupBy("row").agg(F.min(F.when(F.col("low") & (F.col("d") >= 0), F.col("d"))).alias("right"), F.max(F.when(F.col("low") & (F.col("d") < 0), F.col("d"))).alias("left"), F.max("d").alias("dr"), F.min("d").alias("dl"))
    return first.select("row", (F.coalesce("right", F.col("dr") + 1) - F.coalesce("left", F.col("dl") - 1) - 1).alias("width"))


def middle(rows: DataFrame, n_cols: int) -> DataFrame:
    """The seam down the middle column."""
    return rows.select("row").distinct().withColumn("sc", F.lit(n_cols // 2))


def feathered(a: DataFrame, b: DataFrame, seam: DataFrame, widths: list[int]) -> DataFrame:
    """width, row, col, v: a blended into b linearly over each width around the seam; one side alone where the other is invalid."""
    both = a.select("row", "col", F.col("v").alias("va")).join(b.select("row", "col", F.col("v").alias("vb")), ["row", "col"], "full").join(small(seam), "row")
    spread = both.withColumn("width", F.explode(F.array(*map(F.lit, widths))))
    wb = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.col("col") - F.col("sc")) / (2.0 * F.col("width"))))
    mixed = (1 - wb) * F.col("va") + wb * F.col("vb")
    return spread.select("width", "row", "col", F.coalesce(mixed, "va", "vb").alias("v"))
