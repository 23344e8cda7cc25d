"""Radiometric adjustment: the global stage, the local stage, and three baselines.

Pixels stay in Spark.  What reaches the driver or one Python group is a table of scenes, overlaps or
blocks: the equations' size, not the rasters'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import SMALL_BYTES, kept, small, spread_percentiles
from . import blocks as blk
from . import tiles
from .overlap import sides as overlap_sides
from .quality import pair_moments, solver_moments

TINY = 1e-12


# -- global stage


class Sparse:
    """A matrix as its entries: products only."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, shape: tuple[int, int]) -> None:
        self.rows, self.cols, self.vals, self.shape = rows, cols, vals, shape

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.vals * x[self.cols], self.shape[0])

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.cols, self.rows, self.vals, self.shape[::-1])


def conjugate_gradients(product: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, x: np.ndarray, rtol: float = 1e-6, most: int = 500) -> np.ndarray:
    """x of product(x) = rhs for a symmetric product without negative curvature; from 0 it has the least norm."""
    left = rhs - product(x)
    way, size, goal = left, left @ left, (rtol * np.linalg.norm(rhs)) ** 2
    for _ in range(most):
        if size <= goal:
            break
        bent = product(way)
        curve = way @ bent
        if curve <= 0:
            break
        x, left = x + size / curve * way, left - size / curve * bent
        size, before = left @ left, size
        way = left + size / before * way
    return x


def solve_compensation(n: int, i: np.ndarray, j: np.ndarray, vi: np.ndarray, vj: np.ndarray, area: np.ndarray, control: int) -> np.ndarray:
    """theta of least squares: theta_i - theta_j = v_j - v_i weighed by shares of area, theta_control = 0; least norm where free."""
    w = np.sqrt(area / area.sum() if area.sum() > 0 else np.full(len(area), 1 / max(1, len(area))))
    k, m = np.arange(len(i)), len(i)
    system = Sparse(np.concatenate([k, k, [m]]), np.concatenate([i, j, [control]]), np.concatenate([w, -w, [1.0]]), (m + 1, n))
    return conjugate_gradients(lambda x: system.T @ (system @ x), system.T @ np.append(w * (vj - vi), 0.0), np.zeros(n), 1e-15, 20 * n)


def compensation(moments: pd.DataFrame, n: int, control: int = 0) -> pd.DataFrame:
    """scene_id, band, theta_mu, theta_sigma from a table of weighed pair moments."""
    out = []
    for band, g in moments.sort_values(["band", "i", "j"]).groupby("band"):
        i, j, area = g["i"].to_numpy(), g["j"].to_numpy(), g["px"].to_numpy(float)
        mu, sd = (solve_compensation(n, i, j, g[f"{k}_i"].to_numpy(), g[f"{k}_j"].to_numpy(), area, control) for k in ("mu", "sd"))
        out.append(pd.DataFrame({"scene_id": np.arange(n), "band": band, "theta_mu": mu, "theta_sigma": sd}))
    return pd.concat(out) if out else pd.DataFrame({"scene_id": [], "band": [], "theta_mu": [], "theta_sigma": []})


def match_moments(pixels: DataFrame, theta: DataFrame) -> DataFrame:
    """v moved to its scene's own moments plus theta: w v + (mu' - w mu), w = sigma' / sigma, or 1 where either is nothing."""
    own = pixels.groupBy("scene_id", "band").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sg"))
    both = own.join(F.broadcast(theta), ["scene_id", "band"])
    to = F.col("sg") + F.col("theta_sigma")
    w = F.when((F.col("sg") < TINY) | (to < TINY), 1.0).otherwise(to / F.nullif("sg", F.lit(0.0)))
    plan = both.select("scene_id", "band", w.alias("w"), (F.col("mu") + F.col("theta_mu") - w * F.col("mu")).alias("shift"))
    return pixels.join(small(plan), ["scene_id", "band"]).withColumn("v", F.col("w") * F.col("v") + F.col("shift")).select(*pixels.columns)


def adjust_global(pixels: DataFrame, overlaps: DataFrame, n_scenes: int, control: int = 0) -> tuple[DataFrame, DataFrame]:
    """Adjusted pixels and the compensation table.  One scene stays as it is; several without an overlap are an error."""
    spark = pixels.sparkSession
    if n_scenes == 1:
        bands = pixels.select("scene_id", "band").distinct()
        return pixels, bands.withColumns({"theta_mu": F.lit(0.0), "theta_sigma": F.lit(0.0)})
    if not 0 <= control < n_scenes:
        raise ValueError(f"control scene {control} is not one of {n_scenes}")
    moments = solver_moments(pair_moments(overlap_sides(pixels, overlaps)), overlaps).toPandas()  # a row an overlap and band
    if not len(moments):
        raise ValueError("several scenes, and no overlap between them")
    theta = spark.createDataFrame(compensation(moments, n_scenes, control).astype({"scene_id": int, "band": int}), "scene_id int, band int, theta_mu double, theta_sigma double")
    return match_moments(pixels, theta), theta


# -- local stage


def scaling(pixels: DataFrame) -> DataFrame:
    """band, vmin, scale: p1 and p99 - p1 over all scenes, scale 1 where flat."""
    q = spread_percentiles(pixels, "v", ["band"], 0.01, 0.99)
    span = F.get("q", F.lit(1)) - F.get("q", F.lit(0))
    return q.select("band", F.get("q", F.lit(0)).alias("vmin"), F.when(span < 1e-10, 1.0).otherwise(span).alias("scale"))


def block_system(mu: np.ndarray, sigma: np.ndarray, bi: np.ndarray, bj: np.ndarray) -> tuple[Sparse, Sparse, np.ndarray]:
    """B (two rows a pair), A (two rows a block) and A's right side, on unknowns a_0, b_0, a_1, ..."""
    t, m = len(mu), len(bi)
    k, b, one = np.arange(m), np.arange(t), np.ones
    big = Sparse(np.concatenate([2 * k] * 4 + [2 * k + 1] * 2), np.concatenate([2 * bi, 2 * bi + 1, 2 * bj, 2 * bj + 1, 2 * bi, 2 * bj]), np.concatenate([mu[bi], one(m), -mu[bj], -one(m), sigma[bi], -sigma[bj]]), (2 * m, 2 * t))
    own = Sparse(np.concatenate([2 * b, 2 * b, 2 * b + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b]), np.concatenate([mu, one(t), sigma]), (2 * t, 2 * t))
    return big, own, np.column_stack([mu, sigma]).ravel()


def soft(x: np.ndarray, k: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - k, 0)


def admm(big: Sparse, own: Sparse, rhs: np.ndarray, lam: float, rho: float = 1.0, most: int = 200, tol: float = 1e-4) -> tuple[np.ndarray, bool, int]:
    """min 1/2 |Bx|^2 + lambda |Ax - b|_1 by splitting off Ax - b, from the identity; x, whether it converged, rounds.  No product of matrices is made."""
    x = np.tile([1.0, 0.0], own.shape[1] // 2)
    split = scaled = np.zeros(len(rhs))
    curved = lambda d: big.T @ (big @ d) + rho * (own.T @ (own @ d))
    for rounds in range(1, most + 1):
        before, x = x, conjugate_gradients(curved, rho * (own.T @ (split - scaled + rhs)), x)
        far = own @ x - rhs + scaled
        split = soft(far, lam / rho)
        scaled = far - split
        if np.linalg.norm(x - before) < tol * (np.linalg.norm(before) + TINY):
            return x, True, rounds
    return x, False, most


def cell_rounds(mu: np.ndarray, sigma: np.ndarray, scene: np.ndarray, lam: float, rho: float, most: int) -> Iterator[np.ndarray]:
    """x after each round of admm() for the blocks of one cell: dense, each round solved exactly."""
    bi, bj = (x.astype(int) for x in np.nonzero(scene[:, None] < scene[None, :]))
    big, own, rhs = block_system(mu, sigma, bi, bj)
    dense = lambda m: np.column_stack([m @ e for e in np.eye(m.shape[1])]) if m.shape[0] else np.zeros(m.shape)
    b, a = dense(big), dense(own)
    m = b.T @ b + rho * a.T @ a
    back = np.linalg.pinv(m, hermitian=True)  # what no equation moves stays at the identity
    x = np.tile([1.0, 0.0], len(mu))
    split = scaled = np.zeros(len(rhs))
    for _ in range(most):
        x = x + back @ (rho * (a.T @ (split - scaled + rhs)) - m @ x)
        far = a @ x - rhs + scaled
        split = soft(far, lam / rho)
        scaled = far - split
        yield x


def solve_blocks(blocks: DataFrame, lam: float, rho: float, most: int, tol: float) -> DataFrame:
    """band, block_id, a, b, converged, rounds: each band on its own; a band that doesn't converge keeps the identity.

    Blocks are tied within a cell alone, so the band's problem falls apart into those of its cells; what
    they share is the round at which the band's coefficients as a whole stand still.  Cells run all rounds
    and hand on the squares of their steps; sums by band and round give that round; cells then run to it.
    No task holds a band.  Blocks have gm, gn, scene_id, band, block_id, mu, sigma.
    """
    cell = ["band", "gm", "gn"]
    parts = blocks.select(*cell, "scene_id", "block_id", "mu", "sigma")

    def steps(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block_id")
        before, far, size = np.tile([1.0, 0.0], len(g)), [], []
        for x in cell_rounds(g["mu"].to_numpy(), g["sigma"].to_numpy(), g["scene_id"].to_numpy(), lam, rho, most):
            far.append(float(((x - before) ** 2).sum()))
            size.append(float((before**2).sum()))
            before = x
        return pd.DataFrame({"band": g["band"].iloc[:1], "far": [far], "size": [size]})

    def solved(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block_id")
        rounds, ok = int(g["rounds"].iloc[0]), bool(g["converged"].iloc[0])
        x = np.tile([1.0, 0.0], len(g))
        for x in cell_rounds(g["mu"].to_numpy(), g["sigma"].to_numpy(), g["scene_id"].to_numpy(), lam, rho, rounds) if ok else ():
            pass
        return pd.DataFrame({"band": g["band"], "block_id": g["block_id"], "a": x[0::2], "b": x[1::2], "converged": ok, "rounds": rounds})

    each = parts.groupBy(*cell).applyInPandas(steps, "band int, far array<double>, size array<double>").select("band", F.posexplode(F.arrays_zip("far", "size")).alias("k", "e"))
    sums = each.groupBy("band", "k").agg(F.sum("e.far").alias("far"), F.sum("e.size").alias("size"))
    still = F.sqrt("far") < tol * (F.sqrt("size") + TINY)
    ends = sums.groupBy("band").agg(F.min(F.when(still, F.col("k") + 1)).alias("k"))
    ends = ends.select("band", F.coalesce("k", F.lit(most)).cast("int").alias("rounds"), F.col("k").isNotNull().alias("converged"))
    return parts.join(F.broadcast(ends), "band").groupBy(*cell).applyInPandas(solved, "band int, block_id long, a double, b double, converged boolean, rounds int")  # a row a band


def adjust_local(pixels: DataFrame, scenes: DataFrame, n_bands: int, block: int = 200, lam: float = 0.5, rho: float = 1.0, most: int = 200, tol: float = 1e-4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adjusted pixels, the blocks with moments in the solver's units, and the coefficients in the pixels' own units.

    The solver's scaling is affine, so it is done on the table of moments; pixels are scanned for the
    scale and the moments, and adjusted in a third pass.  Blocks and coefficients are made once.
    """
    scale = F.broadcast(scaling(pixels))  # a row a band
    at = blk.placed(pixels, scenes, blk.cell_grid(scenes, block))
    raw = blk.block_table(at, n_bands)
    blocks = kept(raw.join(scale, "band").withColumns({"mu": (F.col("mu") - F.col("vmin")) / F.col("scale"), "sigma": F.col("sigma") / F.col("scale")}).select(*raw.columns, "vmin", "scale"))
    coef = solve_blocks(blocks, lam, rho, most, tol)
    spans = blocks.groupBy("band").agg(F.first("vmin").alias("vmin"), F.first("scale").alias("scale"))
    own = kept(coef.join(F.broadcast(spans), "band").select("band", "block_id", "a", (F.col("scale") * F.col("b") + (1 - F.col("a")) * F.col("vmin")).alias("b"), "converged", "rounds"))
    out = blk.idw(at, blocks, own).withColumn("v", F.col("a") * F.col("v") + F.col("b"))
    return out.select(*pixels.columns), blocks.drop("vmin", "scale"), own


# -- baselines


def by_levels(edges: list[tuple[int, int]], root: int) -> list[list[tuple[int, int]]]:
    """(parent, child) edges by their distance from the root: parents come first."""
    seen, out = {root}, []
    while True:
        level = [(p, c) for p, c in edges if p in seen and c not in seen]
        if not level:
            return out
        out.append(level)
        seen |= {c for _, c in level}


def _tree_side(now: DataFrame, overlaps: DataFrame, level: list[tuple[int, int]]) -> DataFrame:
    """child, parent, band, ref (is it the parent's side), v over the overlaps of a level's edges."""
    spark = now.sparkSession
    tree = spark.createDataFrame(level, "parent int, child int")
    wanted = overlaps.join(F.broadcast(tree), F.least("parent", "child").eqNullSafe(F.col("i")) & F.greatest("parent", "child").eqNullSafe(F.col("j")))
    both = overlap_sides(now, wanted.select(*overlaps.columns)).join(F.broadcast(wanted.select("i", "j", "parent", "child")), ["i", "j"])  # a row an edge
    ref = F.when(F.col("side") == "i", F.col("i")).otherwise(F.col("j")) == F.col("parent")
    return both.filter("v IS NOT NULL").select("child", "parent", "band", ref.alias("ref"), "v")


def moment_baseline(pixels: DataFrame, overlaps: DataFrame, edges: list[tuple[int, int]], control: int = 0) -> DataFrame:
    """Each scene takes the moments of its parent's overlap, parents first; under five pixels or a flat side leave it as it is.

    A scene's map is v -> g v + h, so its overlaps' moments follow from the raw ones: the tree is walked
    in the table of moments, a row an overlap and band, and the pixels are met once.
    """
    spark = pixels.sparkSession
    raw = {(r["i"], r["j"], r["band"]): r for r in pair_moments(overlap_sides(pixels, overlaps)).collect()}  # a row an overlap and band
    maps: dict[tuple[int, int], tuple[float, float]] = {}
    for level in by_levels(edges, control):
        for parent, child in level:
            for band in sorted({b for i, j, b in raw if (i, j) == (min(parent, child), max(parent, child))}):
                m = raw[min(parent, child), max(parent, child), band]
                of = lambda scene, m=m: [m[f"{k}_{'i' if scene == m['i'] else 'j'}"] for k in ("mu", "sd", "n")]
                (mur, sdr, nr), (mus, sds, ns) = of(parent), of(child)
                g, h = maps.get((parent, band), (1.0, 0.0))
                if nr >= 5 and ns >= 5 and sds >= TINY:
                    gain = abs(g) * sdr / sds
                    maps[child, band] = (gain, g * mur + h - gain * mus)
    table = spark.createDataFrame([(s, b, g, h) for (s, b), (g, h) in maps.items()], "scene_id int, band int, g double, h double")
    return pixels.join(small(table), ["scene_id", "band"], "left").withColumn("v", F.coalesce(F.col("g") * F.col("v") + F.col("h"), "v")).select(*pixels.columns)


def histogram_baseline(pixels: DataFrame, overlaps: DataFrame, edges: list[tuple[int, int]], control: int = 0, bins: int = 65_536) -> DataFrame:
    """Each scene's values go through its overlap's cumulative histogram onto its parent's, parents first.

    A map is one array a scene and band, made from bin counts, at most `bins` rows a group.  A level's
    maps need its parents' maps and raw pixels, never pixels mapped before, so plans don't grow with depth.
    """

    def lut(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin")
        cs, cr = (np.cumsum(np.bincount(g["bin"], g[c], bins)) for c in ("cs", "cr"))
        lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
        centre = lo + (np.arange(bins) + 0.5) * (hi - lo) / bins
        to = np.interp(cs / cs[-1], cr / cr[-1], centre)
        return pd.DataFrame({"scene_id": g["child"].iloc[:1], "band": g["band"].iloc[:1], "lo": lo, "hi": hi, "to": [to]})

    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).cast("int")
    kind = "scene_id int, band int, lo double, hi double, to array<double>"

    def mapped(px: DataFrame, maps: DataFrame | None, scene: str, when: Column) -> DataFrame:
        """px with v through its scene's map, where when holds and there is one."""
        if maps is None:
            return px
        on = maps.withColumnRenamed("scene_id", scene)
        if maps.count() * 8 * bins <= SMALL_BYTES:
            return px.join(F.broadcast(on), [scene, "band"], "left").withColumn("v", F.when(F.col("v").isNotNull(), F.coalesce(F.when(when, F.get("to", place)), "v"))).select(*px.columns)
        ranged = px.join(on.select(scene, "band", "lo", "hi"), [scene, "band"], "left").withColumn("bin", F.when(when, place))
        flat = on.select(scene, "band", F.posexplode("to").alias("bin", "to"))
        return ranged.join(flat, [scene, "band", "bin"], "left").withColumn("v", F.when(F.col("v").isNotNull(), F.coalesce("to", "v"))).select(*px.columns)

    maps = None
    for level in by_levels(edges, control):
        side = mapped(_tree_side(pixels, overlaps, level), maps, "parent", F.col("ref"))
        span = side.groupBy("child", "band").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_if(F.col("ref")).alias("nr"), F.count_if(~F.col("ref")).alias("ns")).filter(f"nr >= 10 AND ns >= 10 AND hi - lo >= {TINY}")
        counts = side.join(F.broadcast(span.drop("nr", "ns")), ["child", "band"]).groupBy("child", "band", "lo", "hi", place.alias("bin")).agg(F.count_if(F.col("ref")).alias("cr"), F.count_if(~F.col("ref")).alias("cs"))  # span: a row a scene and band
        made = kept(counts.groupBy("child", "band").applyInPandas(lut, kind))
        maps = made if maps is None else maps.unionByName(made)
    return mapped(pixels, maps, "scene_id", F.lit(True))


def wallis_baseline(pixels: DataFrame, overlaps: DataFrame, control: int = 0, window: int = 51, mean: float | None = None, sd: float | None = None, tile: int = tiles.SIZE) -> DataFrame:
    """(v - m) T_sd / (s + tiny) + T_m with Gaussian local moments m, s and the control's overlap moments T; the control stays."""
    window += 1 - window % 2
    both = pair_moments(overlap_sides(pixels, overlaps))
    c = F.when(F.col("i") == control, F.struct(F.col("mu_i").alias("mu"), F.col("sd_i").alias("sd"), F.col("n_i").alias("n"))).when(F.col("j") == control, F.struct(F.col("mu_j").alias("mu"), F.col("sd_j").alias("sd"), F.col("n_j").alias("n")))
    goal = both.select("band", c.alias("c")).groupBy("band").agg(F.coalesce(F.avg(F.when(F.col("c.n") > 5, F.col("c.mu"))), F.lit(0.0)).alias("tm"), F.coalesce(F.avg(F.when(F.col("c.n") > 5, F.col("c.sd"))), F.lit(1.0)).alias("ts"))
    if mean is not None:
        goal = goal.withColumn("tm", F.lit(mean))
    if sd is not None:
        goal = goal.withColumn("ts", F.lit(sd))
    local = tiles.local_moments(tiles.cut(pixels, tile), tiles.gaussian(window))
    w = tiles.pixels(local, v="v", w="weight", x="first", xx="second")
    m: Column = F.col("x") / F.greatest("w", F.lit(TINY))
    s = F.sqrt(F.greatest(F.lit(0.0), F.col("xx") / F.greatest("w", F.lit(TINY)) - m * m))
    out = w.join(F.broadcast(goal), "band", "left")
    return out.withColumn("v", F.when(F.col("scene_id") == control, F.col("v")).otherwise((F.col("v") - m) * F.coalesce("ts", F.lit(1.0)) / (s + TINY) + F.coalesce("tm", F.lit(0.0)))).select(*pixels.columns)
