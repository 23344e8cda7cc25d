"""Co-registration: block matches by phase correlation, controls, models, displacement fields and warps.

A match is a row: i, j, ref_x, ref_y, tgt_x, tgt_y, dx, dy, confidence.  The kernel sees one block pair at
a time; screening, inliers, weighted means and gates are plans over the match table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pixels import percentiles, small
from .diagnostics import joint_inliers, mad_inliers

MATCH = "i int, j int, br int, bc int, ref_x double, ref_y double, tgt_x double, tgt_y double, dx double, dy double, confidence double, valid_share double, texture double"


def structural(img: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Sobel magnitude of the image stretched between its 2nd and 98th percentiles and smoothed, 0 where invalid; raw under 100 valid pixels."""
    if ok.sum() < 100:
        return np.where(ok, img, 0.0)
    lo, hi = np.percentile(img[ok], [2, 98])
    x = np.clip((np.where(ok, img, lo) - lo) / max(hi - lo, 1e-8), 0, 1)
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(x, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = sum(w * np.take(p, range(i, i + x.shape[axis]), axis) for i, w in enumerate(k))
    p = np.pad(x, 1, mode="symmetric")
    d, s = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return np.where(ok, np.hypot(d[:-2] + 2 * d[1:-1] + d[2:], s[:, :-2] + 2 * s[:, 1:-1] + s[:, 2:]), 0.0)


def _upsampled(product: np.ndarray, peak: tuple[float, float], factor: int) -> tuple[float, float]:
    """The peak of the correlation on a grid of 1 / factor around a whole-pixel peak: a matrix Fourier transform of that patch."""
    h, w = product.shape
    span = np.arange(-1.5 * factor, 1.5 * factor + 1) / factor
    ky = np.exp(2j * np.pi * np.outer(peak[0] + span, np.fft.fftfreq(h)))
    kx = np.exp(2j * np.pi * np.outer(np.fft.fftfreq(w), peak[1] + span))
    best = np.unravel_index(np.abs(ky @ product @ kx).argmax(), (len(span), len(span)))
    return peak[0] + span[best[0]], peak[1] + span[best[1]]


def ncc(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    down = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / down) if down > 0 else 0.0


def shifted(img: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """img moved by (dy, dx), bilinear, NaN where nothing comes from."""
    h, w = img.shape
    y, x = np.mgrid[0:h, 0:w] - np.array([dy, dx])[:, None, None]
    return bilinear(img, y, x)


def bilinear(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at points, from the four pixels around with weights shared among the valid; NaN outside or where the nearest is invalid."""
    h, w = img.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    top, low = np.zeros(y.shape), np.zeros(y.shape)
    for i in (0, 1):
        for j in (0, 1):
            wt = (1 - np.abs(y - y0 - i)) * (1 - np.abs(x - x0 - j))
            inside = (y0 + i >= 0) & (y0 + i < h) & (x0 + j >= 0) & (x0 + j < w)
            v = img[np.clip(y0 + i, 0, h - 1), np.clip(x0 + j, 0, w - 1)]
            good = inside & ~np.isnan(v) & (wt > 1e-12)
            top += np.where(good, wt * np.where(good, v, 0), 0)
            low += np.where(good, wt, 0)
    near = (np.rint(y) >= 0) & (np.rint(y) < h) & (np.rint(x) >= 0) & (np.rint(x) < w)
    held = near & ~np.isnan(img[np.clip(np.rint(y).astype(int), 0, h - 1), np.clip(np.rint(x).astype(int), 0, w - 1)])
    return np.where(held & (low > 0), top / np.where(low > 0, low, 1), np.nan)


def phase_shift(ref: np.ndarray, tgt: np.ndarray, factor: int = 50) -> tuple[float, float, float]:
    """dy, dx that move tgt onto ref, and confidence (correlation of the two after the move); NaN marks invalid pixels.

    Under 100 jointly valid pixels there is no answer: (0, 0, 0).  The phase tells a shift up to a
    period only, so the sign choices of each axis are compared by correlation.
    """
    ok = ~np.isnan(ref) & ~np.isnan(tgt)
    if ok.sum() < 100:
        return 0.0, 0.0, 0.0
    a, b = structural(ref, ~np.isnan(ref)), structural(tgt, ~np.isnan(tgt))
    h, w = a.shape
    product = np.fft.fft2(a - a.mean()) * np.conj(np.fft.fft2(b - b.mean()))
    product /= np.maximum(np.abs(product), 1e-12)
    corr = np.abs(np.fft.ifft2(product))
    py, px = np.unravel_index(corr.argmax(), corr.shape)
    dy, dx = _upsampled(product, (py if py <= h // 2 else py - h, px if px <= w // 2 else px - w), factor)
    best = (0.0, 0.0, -1.0)
    for cy in {dy, dy - np.sign(dy) * h}:
        for cx in {dx, dx - np.sign(dx) * w}:
            if abs(cy) >= h - 2 or abs(cx) >= w - 2:
                continue
            moved = shifted(np.where(np.isnan(tgt), np.nan, tgt), cy, cx)
            both = ~np.isnan(moved) & ~np.isnan(ref)
            if both.sum() >= 100:
                c = ncc(ref[both], moved[both])
                best = max(best, (cy, cx, c), key=lambda t: t[2])
    return (float(best[0]), float(best[1]), max(0.0, best[2])) if best[2] > -1 else (0.0, 0.0, 0.0)


def match_block(g: pd.DataFrame) -> pd.DataFrame:
    r0, c0 = g["r"].min(), g["c"].min()
    h, w = int(g["r"].max() - r0 + 1), int(g["c"].max() - c0 + 1)
    ref, tgt = (np.full((h, w), np.nan) for _ in "rt")
    ref[g["r"] - r0, g["c"] - c0], tgt[g["r"] - r0, g["c"] - c0] = g["vi"], g["vj"]
    both = ~np.isnan(ref) & ~np.isnan(tgt)
    dy, dx, conf = phase_shift(ref, tgt)
    x, y = c0 + w / 2, r0 + h / 2
    texture = float(min(np.nanstd(ref), np.nanstd(tgt))) if both.any() else 0.0
    return pd.DataFrame({"i": g["i"].iloc[:1], "j": g["j"].iloc[:1], "br": g["br"].iloc[:1], "bc": g["bc"].iloc[:1], "ref_x": x, "ref_y": y, "tgt_x": x - dx, "tgt_y": y - dy, "dx": dx, "dy": dy, "confidence": conf, "valid_share": both.mean(), "texture": texture})


def block_matches(joint: DataFrame, block: int = 512) -> DataFrame:
    """A match for each block of the aligned overlap (i, j, r, c, vi, vj), blocks at half steps: a group is one block."""
    half = max(1, block // 2)
    cell = lambda c: F.floor(F.col(c) / half).cast("int")
    spread = joint.withColumns({"br": cell("r"), "bc": cell("c")})
    for k in ("br", "bc"):
        spread = spread.withColumn(k, F.explode(F.when(F.col(k) > 0, F.array(F.col(k), F.col(k) - 1)).otherwise(F.array(k))))
    return spread.groupBy("i", "j", "br", "bc").applyInPandas(match_block, MATCH)


def screened(matches: DataFrame, confidence: float = 0.5, max_shift: float = 40.0, global_sd: DataFrame | None = None) -> DataFrame:
    """matches with reason: null for those that pass (30 % jointly valid, texture, confidence, shift)."""
    both = matches.join(small(global_sd), ["i", "j"]) if global_sd is not None else matches.withColumn("sd", F.lit(0.0))
    reason = (
        F.when(F.col("valid_share") < 0.3, "few valid pixels")
        .when(F.col("texture") <= F.greatest(0.1 * F.col("sd"), F.lit(1e-4)), "little texture")
        .when(F.col("confidence") <= confidence, "low confidence")
        .when((F.abs("dx") >= max_shift) | (F.abs("dy") >= max_shift), "large shift")
    )
    return both.withColumn("reason", reason).drop("sd")


def screening_counts(screened_matches: DataFrame) -> DataFrame:
    return screened_matches.groupBy("i", "j", F.coalesce("reason", F.lit("accepted")).alias("reason")).count()


def pair_shift(matches: DataFrame, least: int = 3) -> DataFrame:
    """i, j, dx, dy (means weighed by confidence over joint inliers), n_blocks, confidence, rmse, p95; pairs of under three inliers are left out."""
    held = joint_inliers(matches, "dx", "dy", "i", "j")
    w = F.col("confidence")
    mean = held.groupBy("i", "j").agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}") for c in ("dx", "dy")], F.count(F.lit(1)).alias("n_blocks"), F.avg(w).alias("conf"))
    left = held.join(small(mean), ["i", "j"]).withColumn("e", F.hypot(F.col("dx") - F.col("mdx"), F.col("dy") - F.col("mdy")))
    err = left.groupBy("i", "j").agg(F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), percentiles("e", 0.95).alias("p95"))
    return mean.join(err, ["i", "j"]).filter(F.col("n_blocks") >= least).select("i", "j", F.col("mdx").alias("dx"), F.col("mdy").alias("dy"), "n_blocks", F.col("conf").alias("confidence"), "rmse", "p95")


def residual_stats(matches: DataFrame, dx: float = 0.0, dy: float = 0.0, *by: str) -> DataFrame:
    """by: median, rmse, p90, p95 and greatest distance of the matches' shifts from a model shift."""
    e = F.hypot(F.col("dx") - dx, F.col("dy") - dy)
    out = matches.withColumn("e", e).groupBy(*by).agg(percentiles("e", 0.5, 0.9, 0.95).alias("q"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.max("e").alias("greatest"), F.count("e").alias("n"))
    return out.select(*by, F.get("q", F.lit(0)).alias("median"), "rmse", F.get("q", F.lit(1)).alias("p90"), F.get("q", F.lit(2)).alias("p95"), "greatest", "n")


def quality_gate(edges: DataFrame) -> DataFrame:
    """edges with grade: PREFERRED, ACCEPTABLE or FAIL by residual shift, rmse, p95 and blocks."""
    mag = F.hypot("dx", "dy")
    good = (mag <= 0.3) & (F.col("rmse") <= 0.75) & (F.col("p95") <= 1.2) & (F.col("n_blocks") >= 3)
    fair = (mag <= 0.5) & (F.col("rmse") <= 1.0) & (F.col("p95") <= 1.5) & (F.col("n_blocks") >= 3)
    return edges.withColumn("grade", F.when(good, "PREFERRED").when(fair, "ACCEPTABLE").otherwise("FAIL"))


def affine_valid(stats: DataFrame) -> DataFrame:
    """stats (inliers, inlier_ratio, scale_x, scale_y, rotation, shear in degrees) with ok."""
    near = lambda c: F.col(c).between(0.98, 1.02)
    return stats.withColumn("ok", (F.col("inliers") >= 20) & (F.col("inlier_ratio") >= 0.6) & near("scale_x") & near("scale_y") & (F.abs("rotation") <= 1) & (F.abs("shear") <= 1))


def residual_controls(matches: DataFrame, dx: float, dy: float, confidence: float = 0.75) -> DataFrame:
    """x, y, rdx, rdy, conf: what a global shift leaves, confident and within three MADs."""
    rest = matches.filter(F.col("confidence") >= confidence).select("i", "j", F.col("ref_x").alias("x"), F.col("ref_y").alias("y"), (F.col("dx") - dx).alias("rdx"), (F.col("dy") - dy).alias("rdy"), F.col("confidence").alias("conf"))
    return mad_inliers(rest.withColumn("norm", F.hypot("rdx", "rdy")), "norm", "i", "j").drop("norm")


def balanced_controls(controls: DataFrame, cell: int = 256, per_cell: int = 2, most: int = 60) -> DataFrame:
    """Inliers, at most two of the most confident a grid cell, then the most confident of all: a report of `most`."""
    held = mad_inliers(controls.withColumn("norm", F.hypot("rdx", "rdy")), "norm").drop("norm")
    w = W.partitionBy(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).orderBy(F.col("conf").desc(), "x", "y")
    return held.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_cell).drop("k").orderBy(F.col("conf").desc(), "x", "y").limit(most)


def _apart(distance: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["conf", "x", "y"], ascending=[False, True, True])
        kept: list[int] = []
        xy = g[["x", "y"]].to_numpy()
        for k in range(len(g)):
            if not kept or np.hypot(*(xy[kept] - xy[k]).T).min() >= distance:
                kept.append(k)
        return g.iloc[kept]

    return run


def merged_controls(sets: list[DataFrame], distance: float = 50.0, confidence: float = 0.4) -> DataFrame:
    """Control sets as one: of points nearer than distance the most confident stays, then confidence and MAD filters.

    Greedy and in order, so it runs over one scene's controls at a time, a table of hundreds.
    """
    both = sets[0]
    for s in sets[1:]:
        both = both.unionByName(s)
    apart = both.groupBy("scene_id").applyInPandas(_apart(distance), both.schema)
    return mad_inliers(apart.filter(F.col("conf") >= confidence).withColumn("norm", F.hypot("rdx", "rdy")), "norm", "scene_id").drop("norm")


def fit_affine(src: np.ndarray, dst: np.ndarray, trials: int = 2000, within: float = 0.75, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 2 x 3 affine by seeded RANSAC over three points, refitted on its inliers; the model and the inlier mask."""
    rng, ones = np.random.default_rng(seed), np.column_stack([src, np.ones(len(src))])
    best = np.zeros(len(src), bool)
    for _ in range(trials):
        k = rng.choice(len(src), 3, replace=False)
        if abs(np.linalg.det(ones[k])) < 1e-9:
            continue
        ok = np.hypot(*(ones @ np.linalg.solve(ones[k], dst[k]) - dst).T) < within
        if ok.sum() > best.sum():
            best = ok
    if best.sum() < 3:
        return np.array([[1.0, 0, 0], [0, 1.0, 0]]), best
    return np.linalg.lstsq(ones[best], dst[best], rcond=None)[0].T, best


def affine_parts(m: np.ndarray) -> dict[str, float]:
    """Scales, rotation and shear (degrees) and shift of a 2 x 3 affine."""
    sx = float(np.hypot(m[0, 0], m[1, 0]))
    rot = float(np.arctan2(m[1, 0], m[0, 0]))
    sy = float(np.linalg.det(m[:, :2]) / sx)
    shear = float(np.arctan2(m[0, 0] * m[0, 1] + m[1, 0] * m[1, 1], sx * sx))
    return {"scale_x": sx, "scale_y": sy, "rotation": float(np.degrees(rot)), "shear": float(np.degrees(shear)), "dx": float(m[0, 2]), "dy": float(m[1, 2])}


def thin_plate(points: np.ndarray, values: np.ndarray, smoothing: float = 0.0, neighbours: int = 20) -> Callable[[np.ndarray], np.ndarray]:
    """A thin-plate spline through the nearest neighbours of each place asked for; coordinates are scaled to 0 .. 1."""
    lo, span = points.min(0), max(float((points.max(0) - points.min(0)).max()), 1e-12)
    p = (points - lo) / span
    kernel = lambda d: np.where(d > 0, d * d * np.log(np.maximum(d, 1e-300)), 0.0)

    def solve(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = p[idx]
        a = kernel(np.hypot(*(q[:, None] - q[None]).transpose(2, 0, 1))) + smoothing * np.eye(len(q))
        b = np.column_stack([np.ones(len(q)), q])
        m = np.block([[a, b], [b.T, np.zeros((3, 3))]])
        return q, np.linalg.lstsq(m, np.vstack([values[idx], np.zeros((3, values.shape[1]))]), rcond=None)[0]

    def at(where: np.ndarray) -> np.ndarray:
        u, n = (where - lo) / span, min(neighbours, len(p))
        near = np.sort(np.argsort(np.hypot(*(u[:, None] - p[None]).transpose(2, 0, 1)), axis=1, kind="stable")[:, :n], axis=1)
        groups, which = np.unique(near, axis=0, return_inverse=True)
        out = np.empty((len(u), values.shape[1]))
        for k, idx in enumerate(groups):
            mine = which.ravel() == k
            q, c = solve(idx)
            d = np.hypot(*(u[mine][:, None] - q[None]).transpose(2, 0, 1))
            out[mine] = kernel(d) @ c[: len(q)] + np.column_stack([np.ones(mine.sum()), u[mine]]) @ c[len(q) :]
        return out

    return at


def field(cells: DataFrame, controls: pd.DataFrame, smoothing: float = 0.0, neighbours: int = 20, cap: float = 2.5) -> DataFrame:
    """cells (scene_id, row, col) with dx, dy of the spline through one scene's controls, capped in length.

    Controls are at most some hundreds (balanced, merged), so they travel with the function.
    """
    pts, vals = controls[["x", "y"]].to_numpy(float), controls[["rdx", "rdy"]].to_numpy(float)

    def run(batches):  # noqa: ANN001, ANN202
        at = thin_plate(pts, vals, smoothing, neighbours)
        for b in batches:
            d = at(b[["col", "row"]].to_numpy(float)) if len(b) else np.empty((0, 2))
            d *= np.minimum(1, cap / np.maximum(np.hypot(*d.T), 1e-12))[:, None]
            yield b.assign(dx=d[:, 0], dy=d[:, 1])

    return cells.select("scene_id", "row", "col").mapInPandas(run, "scene_id int, row int, col int, dx double, dy double")


def hull_fade(cells: DataFrame, corners: np.ndarray, buffer: float = 128.0) -> DataFrame:
    """cells with fade: 1 inside the convex hull, falling to 0 over buffer pixels outside.  A hull has few corners: one expression."""
    x, y, inside, far = F.col("col"), F.col("row"), F.lit(True), []
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, axis=0)):
        ex, ey = float(bx - ax), float(by - ay)
        inside = inside & ((ex * (y - float(ay)) - ey * (x - float(ax))) >= 0)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - float(ax)) * ex + (y - float(ay)) * ey) / max(ex * ex + ey * ey, 1e-300)))
        far.append(F.hypot(x - float(ax) - t * ex, y - float(ay) - t * ey))
    least = F.least(*far) if len(far) > 1 else far[0]
    return cells.withColumn("fade", F.when(inside, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - least / buffer)))


def warp(pixels: DataFrame, fields: DataFrame, nearest: bool = False) -> DataFrame:
    """pixels moved backwards by a field (scene_id, row, col, dx, dy): the value at (col - dx, row - dy) of all bands.

    Bilinear: four equi-joined neighbours a cell, weights shared among the valid; a cell whose nearest
    source pixel is invalid or outside is null.  Rows of the field are the output grid.
    """
    at = fields.withColumns({"fr": F.col("row") - F.col("dy"), "fc": F.col("col") - F.col("dx")})
    at = at.withColumns({"nr": F.rint("fr").cast("int"), "nc": F.rint("fc").cast("int")})
    near = pixels.filter("v IS NOT NULL").withColumnsRenamed({"row": "nr", "col": "nc", "v": "nv"})
    held = at.join(near, ["scene_id", "nr", "nc"]).select("scene_id", "band", "row", "col", "fr", "fc", "nv")
    if nearest:
        out = held.select("scene_id", "band", "row", "col", F.col("nv").alias("v"))
    else:
        corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        four = held.withColumns({"r0": F.floor("fr").cast("int"), "c0": F.floor("fc").cast("int")}).withColumn("k", corner)
        w = (1 - F.abs(F.col("fr") - F.col("r0") - F.col("k.i"))) * (1 - F.abs(F.col("fc") - F.col("c0") - F.col("k.j")))
        wanted = four.select("scene_id", "band", F.col("row").alias("y"), F.col("col").alias("x"), (F.col("r0") + F.col("k.i")).alias("row"), (F.col("c0") + F.col("k.j")).alias("col"), w.alias("w")).filter("w > 1e-12")
        met = wanted.join(pixels.filter("v IS NOT NULL"), ["scene_id", "band", "row", "col"])
        out = met.groupBy("scene_id", "band", F.col("y").alias("row"), F.col("x").alias("col")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    grid = fields.select("scene_id", "row", "col").join(F.broadcast(pixels.select("scene_id", "band").distinct()), "scene_id")  # a row a scene and band
    return grid.join(out, ["scene_id", "band", "row", "col"], "left").select("scene_id", "band", "row", "col", "v")


def constant_field(scenes: DataFrame, shifts: DataFrame) -> DataFrame:
    """scene_id, row, col, dx, dy: each scene's grid with its network shift."""
    both = scenes.join(small(shifts), "scene_id")
    rows = both.select("scene_id", "n_cols", "dx", "dy", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    return rows.select("scene_id", "row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"), "dx", "dy")


def spatial_folds(points: pd.DataFrame, groups: int = 4, folds: int = 5) -> np.ndarray:
    """A fold for each point: groups x groups spatial cells, the largest cell into the smallest fold."""
    cut = lambda c: np.clip(((points[c] - points[c].min()) / max(points[c].max() - points[c].min(), 1e-12) * groups).astype(int), 0, groups - 1)
    cell = (cut("y") * groups + cut("x")).to_numpy()
    names, counts = np.unique(cell, return_counts=True)
    size, fold = np.zeros(min(folds, len(names)), int), {}
    for k in np.lexsort((names, -counts)):
        to = int(size.argmin())
        fold[names[k]], size[to] = to, size[to] + counts[k]
    return np.array([fold[c] for c in cell])


def cross_validate(points: pd.DataFrame, smoothing: float = 0.0, seed: int = 0) -> pd.DataFrame:
    """model, rmse: held-out error of a translation, an affine and a spline over spatial folds of the controls (x, y, rdx, rdy)."""
    xy, d, fold = points[["x", "y"]].to_numpy(float), points[["rdx", "rdy"]].to_numpy(float), spatial_folds(points)
    err: dict[str, list[np.ndarray]] = {"translation": [], "affine": [], "spline": []}
    for k in range(fold.max() + 1):
        on, off = fold != k, fold == k
        if on.sum() < 4:
            continue
        err["translation"].append(d[off] - np.median(d[on], 0))
        m, _ = fit_affine(xy[on], xy[on] + d[on], 200, seed=seed)
        err["affine"].append(d[off] - (np.column_stack([xy[off], np.ones(off.sum())]) @ m.T - xy[off]))
        err["spline"].append(d[off] - thin_plate(xy[on], d[on], smoothing)(xy[off]))
    return pd.DataFrame([{"model": m, "rmse": float(np.sqrt((np.concatenate(e) ** 2).sum(1).mean()))} for m, e in err.items() if e])
