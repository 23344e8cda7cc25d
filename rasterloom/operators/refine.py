"""Refinement and validation of a registration: second passes, corrections, controls by parent, held-out checks.

Matches come from register.block_matches, once for each block size; passes at other confidences are
plans over the same match table.  What a driver loop sees is a row a pair of scenes, or a scene's
controls, at most some hundreds.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import percentiles, small
from . import overlap, register
from .diagnostics import convex_hull, mad_inliers

#: Smoothings that a held-out fold and the four-scene run choose from.
FOLD_SMOOTHINGS, SMOOTHINGS = (0.001, 0.01, 0.05, 0.1, 0.5, 1.0), (0.1, 0.3, 1.0)


def edge_quality(matches: DataFrame) -> DataFrame:
    """i, j, dx, dy, magnitude, rmse, p95, n_blocks, confidence of what screened matches leave of a pair; pairs without three inliers are left out."""
    return register.pair_shift(matches).withColumn("magnitude", F.hypot("dx", "dy"))


# -- second passes


def rematch(matches: DataFrame, first: float = 0.5, second: float = 0.4, max_shift: float = 5.0, enough: int = 20, least: int = 5) -> DataFrame:
    """i, j, dx, dy (means weighed by confidence), confidence, rmse, n_blocks, used: the better of a strict and a lenient pass.

    A strict pass of enough blocks stands.  Else the lenient one wins if the strict has under least
    blocks, or if it has more blocks and an error under 1.5 times the strict one's.  Pairs with neither are left out.
    """

    def one(threshold: float, k: int) -> DataFrame:
        kept = register.screened(matches, threshold, max_shift).filter("reason IS NULL")
        w = F.col("confidence")
        mean = kept.groupBy("i", "j").agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}") for c in ("dx", "dy")])
        e = kept.join(small(mean), ["i", "j"]).withColumn("e", F.hypot(F.col("dx") - F.col("mdx"), F.col("dy") - F.col("mdy")))
        out = e.groupBy("i", "j").agg(F.first("mdx").alias("dx"), F.first("mdy").alias("dy"), F.avg("confidence").alias("confidence"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.count(F.lit(1)).alias("n_blocks"))
        return out.filter(f"n_blocks >= {least}").select("i", "j", F.struct("dx", "dy", "confidence", "rmse", "n_blocks", F.lit(threshold).alias("used")).alias(f"r{k}"))

    both = one(first, 1).join(one(second, 2), ["i", "j"], "full")
    more = (F.col("r2.n_blocks") > F.col("r1.n_blocks")) & (F.col("r2.rmse") / F.greatest("r1.rmse", F.lit(1e-10)) < 1.5)
    best = F.when(F.col("r1").isNull(), F.col("r2")).when(F.col("r2").isNull() | (F.col("r1.n_blocks") >= enough), F.col("r1")).when(more, F.col("r2")).otherwise(F.col("r1"))
    return both.select("i", "j", best.alias("r")).select("i", "j", "r.*")


def rematched(matches: DataFrame, summary: DataFrame, max_shift: float = 5.0) -> DataFrame:
    """The matches behind rematch()'s choice."""
    kept = register.screened(matches, 0.0, max_shift).filter("reason IS NULL").join(small(summary.select("i", "j", "used")), ["i", "j"])
    return kept.filter("confidence > used").drop("used", "reason")


def multiscale_matches(joint: DataFrame, sizes: tuple[int, ...] = (512, 384, 256)) -> DataFrame:
    """Matches of several block sizes pooled, with their size as "block"."""
    return reduce(DataFrame.unionByName, [register.block_matches(joint, s).withColumn("block", F.lit(s)) for s in sizes])


def correction_accepted() -> Column:
    """Of an edge's quality: sure enough, and a shift worth making, of 0.3 to 5 pixels."""
    return (F.col("n_blocks") >= 3) & (F.col("confidence") >= 0.45) & (F.col("rmse") <= 0.75) & (F.col("p95") <= 1.2) & (F.col("magnitude") > 0.3) & (F.col("magnitude") <= 5)


def refined_shifts(pixels: DataFrame, scenes: DataFrame, overlaps: DataFrame, shifts: dict[int, tuple[float, float]], band: int = 0, control: int = 0, target: int = 1, block: int = 512, rounds: int = 2) -> tuple[dict[int, tuple[float, float]], list[dict]]:
    """Shifts with the target's corrected by what is left against the control, and a record a round.  Every round warps the original pixels."""
    spark, out, log = pixels.sparkSession, dict(shifts), []
    i, j = min(control, target), max(control, target)
    for k in range(rounds):
        table = spark.createDataFrame([(s, *map(float, out[s])) for s in (i, j)], "scene_id int, dx double, dy double")
        near = pixels.filter((F.col("band") == band) & F.col("scene_id").isin(i, j))
        moved = register.warp(near, register.constant_field(scenes, table))
        joint = overlap.joint(moved, overlaps.filter((F.col("i") == i) & (F.col("j") == j)))
        found = edge_quality(register.screened(register.block_matches(joint, block)).filter("reason IS NULL")).withColumn("accepted", correction_accepted()).first()  # a row a pair
        log.append({"round": k, "scene": target, "accepted": bool(found and found["accepted"]), **({c: found[c] for c in ("dx", "dy", "magnitude", "rmse", "p95", "n_blocks")} if found else {"reason": "unavailable"})})
        if not log[-1]["accepted"]:
            break
        sign = 1 if target == j else -1
        out[target] = (out[target][0] + sign * found["dx"], out[target][1] + sign * found["dy"])
    out[control] = (0.0, 0.0)
    return out, log


def two_edge_correction(edges: DataFrame, scene: str = "j", limit: float = 2.0) -> DataFrame:
    """scene, dx, dy: the mean of what its edges leave, weighed by confidence times blocks over error; for scenes with two edges or more and a mean within limit."""
    w = F.col("confidence") * F.col("n_blocks") / F.greatest("rmse", F.lit(0.1))
    mean = edges.groupBy(scene).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in ("dx", "dy")], F.count(F.lit(1)).alias("n"))
    return mean.filter((F.col("n") >= 2) & (F.hypot("dx", "dy") <= limit)).drop("n")


def correction_improves(before: DataFrame, after: DataFrame, scene: str = "j") -> DataFrame:
    """scene, improves: its worst edge and its summed error fall, and no edge's p95 rises by over a tenth."""
    side = lambda x, k: x.select("i", "j", *[F.col(c).alias(f"{c}{k}") for c in ("magnitude", "rmse", "p95")])
    both = side(before, 0).join(side(after, 1), ["i", "j"])
    better = (F.max("magnitude1") < F.max("magnitude0")) & (F.sum("rmse1") < F.sum("rmse0")) & F.every(F.col("p951") <= 1.1 * F.col("p950"))
    return both.groupBy(scene).agg(better.alias("improves"))


def smoothing_choice(candidates: DataFrame) -> DataFrame:
    """smoothing, score, passed, chosen: over two edges each (smoothing, edge 0 strict or 1 lenient, magnitude, rmse, p95, magnitude0, p950 before).

    The score adds magnitudes, errors and half the p95s.  To pass, each edge keeps its own limits, the
    strict one's p95 grows by 0.2 at most and the lenient one's magnitude not at all.
    """
    strict = (F.col("magnitude") <= 0.3) & (F.col("rmse") <= 0.75) & (F.col("p95") <= F.least(F.lit(1.2), F.coalesce(F.col("p950"), F.lit(1e300)) + 0.2))
    lenient = (F.col("magnitude") <= F.least(F.lit(0.5), F.coalesce("magnitude0", F.lit(1e300)))) & (F.col("rmse") <= 1.0) & (F.col("p95") <= 1.5)
    held = candidates.withColumn("ok", F.when(F.col("edge") == 0, strict).otherwise(lenient))
    out = held.groupBy("smoothing").agg((F.sum("magnitude") + F.sum("rmse") + 0.5 * F.sum("p95")).alias("score"), F.every("ok").alias("passed"))
    first = F.row_number().over(W.orderBy(F.col("passed").desc(), "score", "smoothing"))  # a row a smoothing
    return out.withColumn("chosen", F.col("passed") & (first == 1))


# -- controls by parent


def parent_controls(matches: DataFrame, tree: DataFrame, shifts: DataFrame, confidence: float = 0.5, least: int = 10) -> DataFrame:
    """scene_id, x, y, rdx, rdy, conf: each child's measured shifts against its parent, less what the network gave it.

    A match of (parent, child) lies at the child's point and moves the child; one of (child, parent) lies
    at the child's point, its reference, and is turned round.  Confident points only, at least ten a child, within three MADs.
    """
    down = matches.join(small(tree), (F.col("i") == F.col("parent")) & (F.col("j") == F.col("child"))).select("parent", "child", F.col("tgt_x").alias("x"), F.col("tgt_y").alias("y"), "dx", "dy", "confidence")
    up = matches.join(small(tree), (F.col("j") == F.col("parent")) & (F.col("i") == F.col("child"))).select("parent", "child", F.col("ref_x").alias("x"), F.col("ref_y").alias("y"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"), "confidence")
    at = lambda p: shifts.select(F.col("scene_id").alias(p), F.col("dx").alias(f"{p}_dx"), F.col("dy").alias(f"{p}_dy"))
    rest = down.unionByName(up).filter(F.col("confidence") >= confidence).join(small(at("parent")), "parent").join(small(at("child")), "child")
    rest = rest.select(F.col("child").alias("scene_id"), "x", "y", *[(F.col(c) - (F.col(f"child_{c}") - F.col(f"parent_{c}"))).alias(f"r{c}") for c in ("dx", "dy")], F.col("confidence").alias("conf"))
    enough = rest.groupBy("scene_id").count().filter(F.col("count") >= least).select("scene_id")
    return mad_inliers(rest.join(small(enough), "scene_id").withColumn("norm", F.hypot("rdx", "rdy")), "norm", "scene_id").drop("norm")


# -- validation away from the training points


def grid_blocks(joint: DataFrame, block: int, step: int, offset: int) -> DataFrame:
    """joint (one band) with br, bc: every full block of a grid that starts offset pixels within the overlap holds its pixels."""
    size = joint.groupBy("i", "j").agg(F.max("r").alias("h"), F.max("c").alias("w"))
    spread = joint.join(small(size), ["i", "j"])
    for k, at, most in (("br", "r", "h"), ("bc", "c", "w")):
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - offset - block + 1) / step)).cast("int")
        high = F.least(F.floor((F.col(at) - offset) / step), F.floor((F.col(most) + 1 - block - offset) / step)).cast("int")
        spread = spread.withColumn(k, F.explode(F.when((high >= low) & (F.col(at) >= offset), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    return spread.drop("h", "w")


def independent_grid(joint: DataFrame, training: DataFrame, block: int = 256, step: int = 256, offset: int = 128, min_distance: float = 256.0, confidence: float = 0.5, max_shift: float = 10.0) -> DataFrame:
    """i, j, br, bc, centre_x, centre_y, nearest, dx, dy, magnitude, confidence, valid_share, texture, reason (null: accepted) of each block of an offset grid.

    training (i, j, x, y): the points a model was fitted on, in the overlap's own pixels.  Blocks nearer
    than min_distance to one of them are not matched at all.
    """
    cells = grid_blocks(joint, block, step, offset)
    centre = lambda k: F.lit(offset) + F.col(k) * step + block // 2
    places = cells.select("i", "j", "br", "bc").distinct().withColumns({"centre_x": centre("bc"), "centre_y": centre("br")})
    near = places.join(small(training.select("i", "j", "x", "y")), ["i", "j"]).groupBy("i", "j", "br", "bc").agg(F.min(F.hypot(F.col("x") - F.col("centre_x"), F.col("y") - F.col("centre_y"))).alias("nearest"))
    placed = places.join(near, ["i", "j", "br", "bc"], "left")
    close = F.coalesce(F.col("nearest") < min_distance, F.lit(False))
    far = placed.filter(~close)
    found = cells.join(small(far.select("i", "j", "br", "bc")), ["i", "j", "br", "bc"]).groupBy("i", "j", "br", "bc").applyInPandas(register.match_block, register.MATCH)
    out = placed.join(found.select("i", "j", "br", "bc", "dx", "dy", "confidence", "valid_share", "texture"), ["i", "j", "br", "bc"], "left")
    reason = (
        F.when(close, "near training").when(F.col("valid_share") < 0.3, "few valid pixels").when(F.col("texture") < 1e-4, "little texture")
        .when(F.col("confidence") < confidence, "low confidence").when((F.abs("dx") >= max_shift) | (F.abs("dy") >= max_shift), "large shift")
    )
    return out.withColumns({"magnitude": F.hypot("dx", "dy"), "reason": reason})


def validation_summary(blocks: DataFrame, enough: int = 20) -> DataFrame:
    """i, j: counts, statistics of the accepted blocks' residuals, the share of blocks accepted, and why it fails, if it does."""
    ok = F.col("reason").isNull()
    size = F.when(ok, F.col("magnitude"))
    out = blocks.groupBy("i", "j").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if(ok).alias("n_accepted"), *[F.count_if(F.col("reason") == r).alias(f"n_{r.replace(' ', '_')}") for r in ("near training", "few valid pixels", "little texture", "low confidence", "large shift")],
        percentiles(size, 0.5, 0.9, 0.95).alias("q"), F.avg(size).alias("mean"), F.sqrt(F.avg(size**2)).alias("rmse"), F.max(size).alias("greatest"), F.avg(F.when(ok, F.col("confidence"))).alias("mean_confidence"),
    )
    why = F.when(F.col("n_accepted") == 0, "no accepted block").when(F.col("n_accepted") < enough, "too few accepted blocks")
    return out.select("i", "j", "n_blocks", "n_accepted", *[c for c in out.columns if c.startswith("n_") and c not in ("n_blocks", "n_accepted")], *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("median", "p90", "p95"))], "mean", "rmse", "greatest", "mean_confidence", (F.col("n_accepted") / F.col("n_blocks")).alias("coverage"), why.alias("failure"))


def holdout(pixels: DataFrame, scenes: DataFrame, overlaps: DataFrame, matches: pd.DataFrame, i: int = 0, j: int = 1, groups: int = 4, folds: int = 5, block: int = 512, step: int = 256, least: int = 30, least_blocks: int = 3, cap: float = 2.5) -> pd.DataFrame:
    """A row a spatial fold: a shift and a spline fitted on the other folds' matches (ref_x, ref_y, dx, dy, confidence), the scene warped by them, and what blocks near the held-out matches still show.

    pixels has one band.  Blocks count at confidence 0.5, else 0.4, else 0.3, whichever first leaves
    enough; their shift is under 5 pixels.  fold, n_train, n_blocks, threshold, smoothing, dx, dy, median, rmse, p95, failure.
    """
    columns = ["fold", "n_train", "n_blocks", "threshold", "smoothing", "dx", "dy", "median", "rmse", "p95", "failure"]
    if len(matches) < least:
        return pd.DataFrame([], columns=columns)
    xy, d, conf = matches[["ref_x", "ref_y"]].to_numpy(float), matches[["dx", "dy"]].to_numpy(float), matches["confidence"].to_numpy(float)
    fold = register.spatial_folds(matches.rename(columns={"ref_x": "x", "ref_y": "y"}), groups, folds)
    spark, pair, out = pixels.sparkSession, overlaps.filter((F.col("i") == i) & (F.col("j") == j)), []
    if fold.max() < 2:
        return pd.DataFrame([], columns=columns)
    for k in range(fold.max() + 1):
        on, row = fold != k, dict.fromkeys(columns) | {"fold": k, "n_train": int((fold != k).sum())}
        out.append(row)
        if on.sum() < least:
            row["failure"] = "too few training points"
            continue
        shift = (conf[on, None] * d[on]).sum(0) / max(conf[on].sum(), 1e-10)
        rest = d[on] - shift
        norm = np.hypot(*rest.T)
        keep = norm <= np.median(norm) + 3 * np.median(np.abs(norm - np.median(norm)))
        row["dx"], row["dy"] = map(float, shift)
        if keep.sum() < least:
            row["failure"] = "too few inliers"
            continue
        p, r = xy[on][keep], rest[keep]
        error = {s: np.percentile(np.hypot(*(register.thin_plate(p, r, s)(p) - r).T), 95) for s in FOLD_SMOOTHINGS}
        row["smoothing"] = min(error, key=error.get)
        corners, controls = convex_hull(p), pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "rdx": r[:, 0], "rdy": r[:, 1]})
        base = register.constant_field(scenes.filter(F.col("scene_id") == j), spark.createDataFrame([(j, *map(float, shift))], "scene_id int, dx double, dy double"))
        local = register.hull_fade(register.field(base, controls, row["smoothing"], 20, cap), corners, 1e-9) if len(corners) > 2 else register.field(base, controls, row["smoothing"], 20, cap).withColumn("fade", F.lit(0.0))
        total = base.join(local.withColumnsRenamed({"dx": "lx", "dy": "ly"}), ["scene_id", "row", "col"]).select("scene_id", "row", "col", (F.col("dx") + F.col("fade") * F.col("lx")).alias("dx"), (F.col("dy") + F.col("fade") * F.col("ly")).alias("dy"))
        moved = register.warp(pixels.filter(F.col("scene_id") == j), total).unionByName(pixels.filter(F.col("scene_id") == i))
        blocks = independent_grid(overlap.joint(moved, pair), spark.createDataFrame([], "i int, j int, x double, y double"), block, step, step // 2, 0.0, 0.0, 5.0).filter("reason IS NULL").select("centre_x", "centre_y", "magnitude", "confidence").toPandas()  # a row a block
        held = xy[~on]
        close = [np.hypot(*(held - c).T).min() <= 1.5 * block for c in blocks[["centre_x", "centre_y"]].to_numpy(float)]
        blocks = blocks[np.array(close, bool)] if len(blocks) else blocks
        for row["threshold"] in (0.5, 0.4, 0.3):
            seen = blocks[blocks["confidence"] >= row["threshold"]]
            if len(seen) >= least_blocks:
                break
        row["n_blocks"] = len(seen)
        if len(seen) < least_blocks:
            row["threshold"], row["failure"] = None, "too few validation blocks"
            continue
        m = seen["magnitude"].to_numpy(float)
        row["median"], row["rmse"], row["p95"] = float(np.median(m)), float(np.sqrt((m**2).mean())), float(np.percentile(m, 95))
    return pd.DataFrame(out, columns=columns)


# -- models as fields, and quick looks at alignment


def affine_field(scenes: DataFrame, models: DataFrame) -> DataFrame:
    """scene_id, row, col, dx, dy of affines (scene_id, a, b, c, d, e, f: x' = a x + b y + c, y' = d x + e y + f): the value moved to (x', y') comes from (x, y)."""
    flat = register.constant_field(scenes, models.select("scene_id", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))).drop("dx", "dy").join(small(models), "scene_id")
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    u, v = F.col("col") - F.col("c"), F.col("row") - F.col("f")
    x, y = (F.col("e") * u - F.col("b") * v) / det, (F.col("a") * v - F.col("d") * u) / det
    return flat.select("scene_id", "row", "col", (F.col("col") - x).alias("dx"), (F.col("row") - y).alias("dy"))


def windowed_shift(ref: np.ndarray, tgt: np.ndarray) -> tuple[float, float, float]:
    """dy, dx of tgt against ref and the peak's height over the next one (10 at most): full cross-correlation under a Hann window, refined by a 5 x 5 centroid."""
    ok = ~np.isnan(ref) & ~np.isnan(tgt)
    if ok.sum() < 100:
        return 0.0, 0.0, 0.0
    h, w = ref.shape
    window = np.hanning(h)[:, None] * np.hanning(w)
    a, b = (np.where(ok, x, 0.0) * window for x in (ref, tgt))
    shape = (2 * h - 1, 2 * w - 1)
    full = np.fft.irfft2(np.fft.rfft2(b, shape) * np.fft.rfft2(a[::-1, ::-1], shape), shape)
    y, x = np.unravel_index(full.argmax(), shape)
    dy, dx = float(y - h + 1), float(x - w + 1)
    if 2 <= y < shape[0] - 2 and 2 <= x < shape[1] - 2:
        patch, step = full[y - 2 : y + 3, x - 2 : x + 3], np.arange(-2, 3)
        if patch.sum() > 0:
            dy, dx = dy + float((patch.sum(1) * step).sum() / patch.sum()), dx + float((patch.sum(0) * step).sum() / patch.sum())
    top = np.partition(full.ravel(), -2)[-2:]
    return dy, dx, min(10.0, float(top[1] / max(top[0], 1e-10)))


def patch_shifts(joint: DataFrame, patch: int = 256) -> DataFrame:
    """i, j, pr, pc, dy, dx, confidence: windowed_shift of each full patch of an overlap (one band); a group is one patch."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.full((patch, patch), np.nan) for _ in "ab")
        a[g["r"] % patch, g["c"] % patch], b[g["r"] % patch, g["c"] % patch] = g["vi"], g["vj"]
        dy, dx, conf = windowed_shift(a, b)
        return pd.DataFrame({"i": g["i"].iloc[:1], "j": g["j"].iloc[:1], "pr": g["pr"].iloc[:1], "pc": g["pc"].iloc[:1], "dy": dy, "dx": dx, "confidence": conf})

    cells = joint.withColumns({"pr": F.floor(F.col("r") / patch).cast("int"), "pc": F.floor(F.col("c") / patch).cast("int")})
    whole = cells.groupBy("i", "j", "pr", "pc").count().filter(F.col("count") == patch * patch).drop("count")
    return cells.join(small(whole), ["i", "j", "pr", "pc"]).groupBy("i", "j", "pr", "pc").applyInPandas(run, "i int, j int, pr int, pc int, dy double, dx double, confidence double")


def difference_by_shift(joint: DataFrame, shifts: range = range(-2, 8)) -> DataFrame:
    """i, j, band, shift, mean, sd, adm of vi(c) - vj(c - shift): how a whole-pixel move along columns changes the agreement."""
    moved = joint.select("i", "j", "band", "r", F.col("c").alias("at"), "vj", F.explode(F.array(*map(F.lit, shifts))).alias("shift")).withColumn("c", F.col("at") + F.col("shift")).drop("at")
    both = joint.select("i", "j", "band", "r", "c", "vi").join(moved, ["i", "j", "band", "r", "c"]).withColumn("x", F.col("vi") - F.col("vj"))
    return both.groupBy("i", "j", "band", "shift").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.abs(F.avg("x")).alias("adm"))
