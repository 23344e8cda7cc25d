"""Affine models of matches by consensus, for all pairs of scenes at once, and what models leave of matches.

Matches are (i, j, x, y, u, v): (x, y) in scene i lies at (u, v) in scene j; a column key (long) tells
matches apart, else a hash of the coordinates does.

Trials are rows.  In each pass a hash deals a pair's matches to buckets of some six; the three first by
hash of a bucket are a trial's points, and Cramer's rule gives its model.  Small pairs take more passes,
large ones hand on only the buckets that make a trial, so about six matches a trial are shuffled and no
task holds a pair.  Each match then meets its pair's models, TRIALS at most, in the task that read it,
and counts for those within reach; counts are summed before they are shuffled.  The model that most count for, the first of equals, is fitted anew to them from
their covariances.

Defined results.  A pair of under three matches, or without three points apart from a line, has the
identity and no inlier.  Matches with a null or non-finite coordinate take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import kept, small, spread_percentiles

TRIALS, WITHIN, PER_TRIAL, FLAT = 2000, 0.75, 6, 1e-9
PAIR = ["i", "j"]
#: A prime, two factors and an offset of the hash that deals matches to trials.
PRIME, FACTORS, OFFSET = 2_147_483_647, (1_597_334_677, 1_103_515_245), 40_503


def mixed(key: Column, turn: Column) -> Column:
    """A number under PRIME, quadratic in key, another one each turn; no product leaves the longs."""
    k = F.pmod(F.pmod(key.cast("long"), F.lit(PRIME)) + OFFSET, F.lit(PRIME))
    return (k * ((k * FACTORS[0] + turn.cast("long") * FACTORS[1]) % PRIME)) % PRIME


def _usable(matches: DataFrame) -> DataFrame:
    key = F.col("key") if "key" in matches.columns else F.xxhash64("x", "y", "u", "v")
    rows = matches.select(*PAIR, key.cast("long").alias("key"), *[F.col(c).cast("double") for c in "xyuv"])
    whole = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyuv"]
    return rows.filter(whole[0] & whole[1] & whole[2] & whole[3])


def trial_models(matches: DataFrame, counts: DataFrame, trials: int = TRIALS) -> DataFrame:
    """i, j, trial, a .. f: u = a x + b y + c and v = d x + e y + f through three matches of each pair (counts: i, j, n)."""
    buckets = F.greatest(F.lit(1), F.floor(F.col("n") / PER_TRIAL)).cast("long")
    turns = F.ceil(F.lit(trials) / buckets).cast("int")
    sized = matches.join(small(counts.filter("n >= 3").select(*PAIR, buckets.alias("buckets"), turns.alias("turns"))), PAIR)
    dealt = sized.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("h", mixed(F.col("key"), F.col("turn")))
    dealt = dealt.withColumn("trial", F.col("turn") * F.col("buckets") + F.col("h") % F.col("buckets")).filter(F.col("trial") < trials)
    first = dealt.groupBy(*PAIR, "trial").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "key", "x", "y", "u", "v"))), 1, 3).alias("p")).filter("size(p) = 3")
    p = first.select(*PAIR, "trial", *[F.col("p")[k][c].alias(f"{c}{k}") for k in range(3) for c in "xyuv"])
    c = F.col
    det = c("x0") * (c("y1") - c("y2")) + c("x1") * (c("y2") - c("y0")) + c("x2") * (c("y0") - c("y1"))

    def solved(t: str) -> list[Column]:
        along = c(f"{t}0") * (c("y1") - c("y2")) + c(f"{t}1") * (c("y2") - c("y0")) + c(f"{t}2") * (c("y0") - c("y1"))
        down = c(f"{t}0") * (c("x2") - c("x1")) + c(f"{t}1") * (c("x0") - c("x2")) + c(f"{t}2") * (c("x1") - c("x0"))
        at = c(f"{t}0") * (c("x1") * c("y2") - c("x2") * c("y1")) + c(f"{t}1") * (c("x2") * c("y0") - c("x0") * c("y2")) + c(f"{t}2") * (c("x0") * c("y1") - c("x1") * c("y0"))
        return [along / det, down / det, at / det]

    apart = p.filter(F.abs(det) >= FLAT)
    return apart.select(*PAIR, "trial", *[e.alias(n) for e, n in zip(solved("u") + solved("v"), "abcdef")])


def _off(m) -> Column:  # noqa: ANN001
    """How far a match lies from where a model puts it."""
    x, y = F.col("x"), F.col("y")
    return F.hypot(m("a") * x + m("b") * y + m("c") - F.col("u"), m("d") * x + m("e") * y + m("f") - F.col("v"))


def fitted(matches: DataFrame, *by: str) -> DataFrame:
    """by, n, a .. f: the least-squares affine of each group's matches, null where they lie on a line."""
    pairs = {"vxx": ("x", "x"), "vyy": ("y", "y"), "vxy": ("x", "y"), "cxu": ("x", "u"), "cyu": ("y", "u"), "cxv": ("x", "v"), "cyv": ("y", "v")}
    s = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(f"m{k}") for k in "xyuv"], *[F.covar_pop(p, q).alias(k) for k, (p, q) in pairs.items()])
    c, det = F.col, F.col("vxx") * F.col("vyy") - F.col("vxy") * F.col("vxy")
    det = F.when(F.abs(det) >= FLAT, det)
    for t, (p, q, r) in {"u": "abc", "v": "def"}.items():
        s = s.withColumns({p: (c(f"cx{t}") * c("vyy") - c(f"cy{t}") * c("vxy")) / det, q: (c(f"cy{t}") * c("vxx") - c(f"cx{t}") * c("vxy")) / det})
        s = s.withColumn(r, c(f"m{t}") - c(p) * c("mx") - c(q) * c("my"))
    return s.select(*by, "n", *"abcdef")


def affine_models(matches: DataFrame, trials: int = TRIALS, within: float = WITHIN) -> DataFrame:
    """i, j, n, inliers, inlier_ratio, a .. f, scale_x, scale_y, rotation, shear (degrees) of each pair."""
    rows = _usable(matches)
    counts = kept(rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")))
    models = small(kept(trial_models(rows, counts, trials)), 96)
    votes = rows.join(models, PAIR).filter(_off(F.col) < within).groupBy(*PAIR, "trial").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*PAIR).agg(F.max_by("trial", F.struct("votes", -F.col("trial"))).alias("trial"), F.max("votes").alias("votes"))
    chosen = kept(models.join(best.filter("votes >= 3"), [*PAIR, "trial"]).select(*PAIR, *"abcdef"))
    inliers = rows.join(small(chosen, 128), PAIR).filter(_off(F.col) < within)
    refit = fitted(inliers, *PAIR).withColumnRenamed("n", "inliers")
    out = counts.join(refit, PAIR, "left").withColumn("inliers", F.coalesce("inliers", F.lit(0).cast("long"))).withColumn("inlier_ratio", F.col("inliers") / F.col("n"))
    out = out.withColumns({k: F.coalesce(k, F.lit(float(k in "ae"))) for k in "abcdef"})
    length = F.hypot("a", "d")
    return out.select(
        *PAIR, "n", "inliers", "inlier_ratio", *"abcdef", length.alias("scale_x"), ((F.col("a") * F.col("e") - F.col("b") * F.col("d")) / length).alias("scale_y"),
        F.degrees(F.atan2("d", "a")).alias("rotation"), F.degrees(F.atan2(F.col("a") * F.col("b") + F.col("d") * F.col("e"), length * length)).alias("shear"),
    )


def median_shifts(matches: DataFrame) -> DataFrame:
    """i, j, dx, dy: the median of u - x and v - y of each pair."""
    both = [spread_percentiles(_usable(matches).select(*PAIR, (F.col(t) - F.col(s)).alias("d")), "d", PAIR, 0.5).select(*PAIR, F.get("q", F.lit(0)).alias(n)) for t, s, n in (("u", "x", "dx"), ("v", "y", "dy"))]
    return both[0].join(both[1], PAIR)


def residuals(matches: DataFrame, translations: DataFrame | None = None, affines: DataFrame | None = None, fields: DataFrame | None = None) -> DataFrame:
    """i, j, model, n, median, rmse, p90, p95, greatest of what each model leaves: translations (i, j, dx, dy), affines (i, j, a .. f), fields (i, j, key, dx, dy: a spline's shift at each match, or any other's)."""
    rows, left = _usable(matches), None
    shifted = lambda df: df.select(*PAIR, F.hypot(F.col("u") - F.col("x") - F.col("dx"), F.col("v") - F.col("y") - F.col("dy")).alias("e"))
    parts = []
    if translations is not None:
        parts.append(("translation", shifted(rows.join(small(translations.select(*PAIR, "dx", "dy")), PAIR))))
    if affines is not None:
        parts.append(("affine", rows.join(small(affines.select(*PAIR, *"abcdef")), PAIR).select(*PAIR, _off(F.col).alias("e"))))
    if fields is not None:
        parts.append(("field", shifted(rows.join(fields.select(*PAIR, "key", "dx", "dy"), [*PAIR, "key"]))))
    for name, df in parts:
        df = df.withColumn("model", F.lit(name))
        left = df if left is None else left.unionByName(df)
    if left is None:
        raise ValueError("no model is given")
    by, left = [*PAIR, "model"], kept(left)
    q = spread_percentiles(left, "e", by, 0.5, 0.9, 0.95)
    sums = left.groupBy(*by).agg(F.count("e").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.max("e").alias("greatest"))
    return sums.join(q, by).select(*by, "n", *[F.get("q", F.lit(k)).alias(c) for k, c in enumerate(("median", "p90", "p95"))], "rmse", "greatest")
