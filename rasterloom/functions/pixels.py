"""Column helpers that every operator shares: validity, rounding, exact percentiles, size-checked broadcasts.

A pixel is invalid if it is null, NaN, infinite, or equal to its scene's nodata value.  Sources turn
invalid values into null once, at the scan, so later plans need only Spark's null rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMALL_BYTES = 32 << 20


def is_valid(v: Column, nodata: Column | None = None) -> Column:
    """Finite and not nodata; nodata may be null, which excludes nothing."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return finite if nodata is None else finite & (nodata.isNull() | (v != nodata))


def to_null(v: Column, nodata: Column | None = None) -> Column:
    return F.when(is_valid(v, nodata), v)


def rounded_to(c: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero; the nudge keeps sums added in another order from parting at exact halves."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), places) + F.lit(0.0)


def percentiles(c: Column | str, *q: float) -> Column:
    """Exact, linearly interpolated: an array for several q, one number for one."""
    return F.percentile(c, F.array(*map(F.lit, q))) if len(q) > 1 else F.percentile(c, F.lit(q[0]))


def spread_percentiles(df: DataFrame, value: str, by: list[str], *q: float, accuracy: int = 10_000) -> DataFrame:
    """by, q: exact, linearly interpolated percentiles as an array, as percentiles gives them, for groups of any number of distinct values.

    A first pass brackets each percentile by approximate quantiles, whose rank is at most 1 / accuracy
    off; a second counts what lies below a bracket and the values inside it, and running sums find the
    exact ones.  Only values inside brackets are shuffled: a share of 8 / accuracy for each percentile, or
    a group of up to accuracy values whole.  A group without a value has a null array.
    """
    names, by = by, [f"_{k}" for k in range(len(by))]  # a group's columns may have any names
    df = df.select(*[F.col(c).alias(k) for c, k in zip(names, by)], F.col(value).alias("x"))
    near, inf = 4 / accuracy, F.lit(float("inf"))
    ask = F.array(*[F.lit(min(1.0, max(0.0, p + s))) for p in q for s in (-near, near)])
    groups = kept(df.groupBy(*by).agg(F.percentile_approx("x", ask, accuracy).alias("b"), F.count("x").alias("total")))
    few = F.col("total") * near < 4
    bounds = [(F.when(few | F.lit(p <= near), -inf).otherwise(F.get("b", F.lit(2 * k))), F.when(few | F.lit(p + near >= 1), inf).otherwise(F.get("b", F.lit(2 * k + 1)))) for k, p in enumerate(q)]
    spans = groups.select(*by, F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("total") - 1)).alias("pos"), lo.alias("lo"), hi.alias("hi")) for k, (p, (lo, hi)) in enumerate(zip(q, bounds))]).alias("spans"))
    flat = [F.get("spans", F.lit(k))[e].alias(f"{e}{k}") for k in range(len(q)) for e in ("lo", "hi")]
    rows = df.filter("x IS NOT NULL").join(small(spans.select(*by, *flat), 64 * len(q)), by)
    # Outside all brackets only the stretch between two of them is kept, and its count.
    stretch, inside = (" + ".join(f"int(x >= lo{k}) + int(x > hi{k})" for k in range(len(q))), " OR ".join(f"x BETWEEN lo{k} AND hi{k}" for k in range(len(q))))
    met = rows.groupBy(*by, F.expr(stretch).alias("stretch"), F.expr(f"CASE WHEN {inside} THEN x END").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"))
    each = met.join(spans, by).select(*by, "n", "x", F.explode(F.filter("spans", lambda s: F.col("x") <= s["hi"])).alias("s"))
    # Without a value: what lies below the bracket.
    counts = each.groupBy(*by, "s.k", "s.pos", F.when(F.col("x") >= F.col("s.lo"), F.col("x")).alias("x")).agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("upto", F.sum("n").over(W.partitionBy(*by, "k", "pos").orderBy(F.col("x").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)))
    at = lambda rank: F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("x")))
    low, high = F.floor("pos"), F.ceil("pos")
    ends = ranked.groupBy(*by, "k", "pos").agg(at(low).alias("lo"), at(high).alias("hi"))
    exact = F.when(low == high, F.col("lo")).otherwise((high - F.col("pos")) * F.col("lo") + (F.col("pos") - low) * F.col("hi"))
    entries = F.filter(F.array_sort(F.collect_list(F.struct("k", exact.alias("y")))), lambda e: e["y"].isNotNull())  # an entry a percentile
    found = ends.groupBy(*by).agg(entries.alias("e"))
    held = F.when(F.size("e") < len(q), F.raise_error(F.lit("a percentile lies outside its bracket")).cast("array<double>")).otherwise(F.transform("e", lambda e: e["y"]))
    out = groups.select(*by).join(found.select(*by, held.alias("q")), by, "left")
    return out.withColumnsRenamed(dict(zip(by, names)))


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def small(df: DataFrame, row_bytes: int = 64, limit: int = SMALL_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit the limit; else df, which joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def kept(df: DataFrame) -> DataFrame:
    """df made once for several uses: a checkpoint where a checkpoint folder is set, else held in memory and on disk."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def last_int(c: Column) -> Column:
    """The last integer in a name, as band files are ordered by."""
    return F.element_at(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), -1).cast("int")
