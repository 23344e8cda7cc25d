"""Spectral distances between two versions of a pixel's band vector: columns o (before) and n (after), arrays of doubles.

All is array functions inside one scan; thresholds that need a mean over all pixels come from one
aggregate row.  A pixel with an invalid band in either version takes no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import dot, is_valid, percentiles, spread_percentiles, total

EPS = 1e-6


def usable(px: DataFrame, nodata: float | None = None) -> DataFrame:
    """Pixels whose every band is valid in both versions."""
    no = F.lit(nodata) if nodata is not None else None
    ok = lambda a: F.forall(a, lambda x: is_valid(x, no))
    return px.filter(ok("o") & ok("n") & (F.size("o") == F.size("n")))


def _against(px: DataFrame, row: DataFrame) -> DataFrame:
    return px.join(F.broadcast(row))  # row is one aggregate row


def sam(px: DataFrame) -> DataFrame:
    """px with sam: the angle between the versions, in degrees.  Pixels of little energy in either are left out."""
    normed = px.withColumns({"no": F.sqrt(dot("o", "o")), "nn": F.sqrt(dot("n", "n"))})
    mean = normed.agg((EPS * F.greatest(F.avg("no"), F.avg("nn"), F.lit(1e-12))).alias("least"))
    kept = _against(normed, mean).filter("no > least AND nn > least")
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("o", "n") / (F.col("no") * F.col("nn"))))
    return kept.withColumn("sam", F.degrees(F.acos(cos))).drop("no", "nn", "least")


def rmse(px: DataFrame) -> DataFrame:
    """px with rmse over the bands."""
    square = F.zip_with("o", "n", lambda a, b: (a - b) * (a - b))
    return px.withColumn("rmse", F.sqrt(total(square) / F.size("o")))


def relative_rmse(px: DataFrame) -> DataFrame:
    """px with rel: rmse over the mean absolute value of both versions; pixels of little energy are left out."""
    level = lambda a: total(F.transform(a, lambda x: F.abs(x))) / F.size(a)
    both = rmse(px).withColumn("level", (level("o") + level("n")) / 2)
    kept = _against(both, both.agg((EPS * F.avg("level")).alias("least"))).filter("level > least")
    return kept.withColumn("rel", F.col("rmse") / F.col("level")).drop("level", "least")


def band_ratio_error(px: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """a, b (bands), pixel_id, err: relative change of the ratio of two bands, where both denominators are large enough."""
    named = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    wide = px.select("pixel_id", F.explode(named).alias("p"), "o", "n")
    at = lambda c, k: F.get(c, F.col(f"p.{k}"))
    vals = wide.select("pixel_id", "p.a", "p.b", at("o", "a").alias("oa"), at("o", "b").alias("ob"), at("n", "a").alias("na"), at("n", "b").alias("nb"))
    least = vals.groupBy("a", "b").agg((EPS * F.avg(F.abs("ob"))).alias("lo"), (EPS * F.avg(F.abs("nb"))).alias("ln"))
    kept = vals.join(F.broadcast(least), ["a", "b"]).filter("abs(ob) > lo AND abs(nb) > ln")  # a row a named pair
    before, after = F.col("oa") / F.col("ob"), F.col("na") / F.col("nb")
    return kept.select("a", "b", "pixel_id", (F.abs(after - before) / F.greatest(F.abs(before), F.lit(1e-10))).alias("err"))


def described(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by: mean, median, p90, p95 and count of a value."""
    at, mean, n = (0.5, 0.9, 0.95), F.avg(value).alias("mean"), F.count(value).alias("n")
    if by:
        out = df.groupBy(*by).agg(mean, n).join(spread_percentiles(df, value, list(by), *at), list(by))
    else:
        out = df.agg(mean, n, percentiles(value, *at).alias("q"))
    return out.select(*by, "mean", *[F.get("q", k).alias(n) for k, n in enumerate(("median", "p90", "p95"))], "n")


def band_correlation(px: DataFrame) -> DataFrame:
    """band, r: Pearson's r of each band before and after."""
    long = px.select(F.posexplode(F.arrays_zip("o", "n")).alias("band", "x"))
    return long.groupBy("band").agg(F.corr("x.o", "x.n").alias("r"))


def correlation_matrices(px: DataFrame) -> DataFrame:
    """p, q, c0, c1: correlations between bands before and after, from pair sums of one scan."""
    long = px.select("pixel_id", F.posexplode(F.arrays_zip("o", "n")).alias("p", "x"), "o", "n")
    pairs = long.select("p", F.posexplode(F.arrays_zip("o", "n")).alias("q", "y"), "x")
    return pairs.groupBy("p", "q").agg(F.corr("x.o", "y.o").alias("c0"), F.corr("x.n", "y.n").alias("c1"))


def frobenius(matrices: DataFrame) -> DataFrame:
    """One row: the Frobenius norm of the change."""
    return matrices.agg(F.sqrt(F.sum((F.col("c1") - F.col("c0")) ** 2)).alias("frobenius"))


def stratified(px: DataFrame, region: Column, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """A sample without replacement of a stated size in each region, by the order of a seeded hash: reruns agree."""
    from pyspark.sql import Window as W

    tagged = px.withColumn("region", region).filter(F.col("region").isin(*sizes))
    place = F.row_number().over(W.partitionBy("region").orderBy(F.xxhash64(F.lit(seed), "pixel_id"), "pixel_id"))
    want = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("region"))
    return tagged.withColumn("place", place).filter(F.col("place") <= want)


def proportional_sizes(counts: dict[str, int], n: int) -> dict[str, int]:
    """Shares of n by the regions' counts, never more than a region has."""
    total_ = sum(counts.values())
    return {k: min(c, round(n * c / total_)) for k, c in counts.items()} if total_ else {}
