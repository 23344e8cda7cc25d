"""Known values and invariants of the raster operators."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.pixels import spread_percentiles
from rasterloom.operators import adjust, blocks, diagnostics, graph, mosaic, overlap, quality, register, render, seams, spectral, stencil, tiles
from rasterloom.plans import cli, config, pipeline
from rasterloom.sources import geotiff, sinks, tiff
from rasterloom.streaming import arrivals

PX = "scene_id int, band int, row int, col int, v double"
SC = "scene_id int, n_rows int, n_cols int, a double, b double, c double, d double, e double, f double"


def pixels(spark, scenes):
    """Arrays (bands, rows, cols) as pixels; NaN becomes null."""
    frames = []
    for s, a in enumerate(scenes):
        a = np.atleast_3d(a) if a.ndim == 3 else a[None]
        b, r, c = np.indices(a.shape)
        frames.append(pd.DataFrame({"scene_id": s, "band": b.ravel(), "row": r.ravel(), "col": c.ravel(), "v": a.ravel().astype(float)}))
    df = spark.createDataFrame(pd.concat(frames), PX)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def strip(spark, scenes, step):
    """Scenes side by side, step pixels apart, tops at their height."""
    return spark.createDataFrame([(k, a.shape[-2], a.shape[-1], 1.0, 0.0, float(k * step), 0.0, -1.0, float(a.shape[-2])) for k, a in enumerate(scenes)], SC)


def array(df, shape, *key):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[k] for k in key)] = np.nan if r["v"] is None else r["v"]
    return out


def trio():
    rng = np.random.RandomState(42)
    return [rng.normal(100, 10, (1, 4, 4)), rng.normal(120, 15, (1, 4, 4)), rng.normal(90, 12, (1, 4, 4))]


# -- geometry


def test_touching_boxes_do_not_overlap(spark):
    a = np.zeros((1, 4, 4))
    assert overlap.detect(strip(spark, [a, a], 4), 0).count() == 0
    r = overlap.detect(strip(spark, [a, a], 2), 0).first()
    assert (r.i, r.j, r.i_c0, r.i_c1, r.j_c0, r.j_c1, r.px) == (0, 1, 2, 4, 0, 2, 8)


def test_cells_find_each_pair_once(spark):
    rng = np.random.default_rng(3)
    boxes = [(k, int(rng.integers(2, 30)), int(rng.integers(2, 30)), 1.0, 0.0, float(rng.integers(-40, 40)), 0.0, -1.0, float(rng.integers(-40, 40))) for k in range(40)]
    got = {(r.i, r.j) for r in overlap.detect(spark.createDataFrame(boxes, SC), 1, cell=7.0).collect()}
    want = set()
    for p, q in itertools.combinations(boxes, 2):
        if p[5] < q[5] + q[2] and q[5] < p[5] + p[2] and p[8] - p[1] < q[8] and q[8] - q[1] < p[8]:
            want.add((p[0], q[0]))
    assert got == want


def test_fractional_window_covers(spark):
    s = spark.createDataFrame([(0, 10, 10, 1.0, 0.0, 0.0, 0.0, -1.0, 10.0), (1, 7, 5, 1.0, 0.0, 2.2, 0.0, -1.0, 8.8)], SC)
    r = overlap.detect(s, 1).first()
    assert (r.i_r0, r.i_r1, r.i_c0, r.i_c1) == (1, 9, 2, 8)


# -- metrics


def test_adm_is_a_difference_of_means(spark):
    a, b = np.concatenate([np.zeros((1, 5, 10)), np.full((1, 5, 10), 100.0)], 1), np.full((1, 10, 10), 50.0)
    px, o = pixels(spark, [a, b]), overlap.detect(strip(spark, [a, b], 0), 1)
    s = quality.summary(quality.per_pair_band(overlap.sides(px, o)), 1).first()
    assert s.adm == 0 and s.adsd == 50


def test_known_adm_and_cd(spark):
    a, b = np.array([10.0, 20.0])[:, None, None] * np.ones((2, 10, 10)), np.array([30.0, 50.0])[:, None, None] * np.ones((2, 10, 10))
    px, o = pixels(spark, [a, b]), overlap.detect(strip(spark, [a, b], 5), 1)
    pb = quality.per_pair_band(overlap.sides(px, o))
    s = quality.summary(pb, 2).first()
    assert s.adm == 25 and s.cd == 1.0 and quality.per_pair(pb).first()["bands"] == 2


def test_cd_matches_numpy(spark):
    a, b = trio()[:2]
    px, o = pixels(spark, [a, b]), overlap.detect(strip(spark, [a, b], 2), 1)
    got = quality.per_pair_band(overlap.sides(px, o)).first().cd
    p, q = a[0][:, 2:].ravel(), b[0][:, :2].ravel()
    lo, hi = min(p.min(), q.min()), max(p.max(), q.max())
    hp, hq = (np.histogram(x, 256, (lo, hi))[0] / len(x) for x in (p, q))
    assert got == pytest.approx(np.abs(hp - hq).sum() / 2)


def test_empty_side_is_skipped(spark):
    a, b = np.full((1, 4, 4), np.nan), np.ones((1, 4, 4))
    px, o = pixels(spark, [a, b]), overlap.detect(strip(spark, [a, b], 2), 1)
    r = quality.per_pair_band(overlap.sides(px, o)).first()
    assert r.skipped_reason and r.adm is None
    m = quality.solver_moments(quality.pair_moments(overlap.sides(px, o)), o).first()
    assert (m.mu_i, m.mu_j, m.px) == (0, 0, 8)


# -- stencils


def sobel_of(z):
    p = np.pad(z, 1, mode="symmetric")
    d, s = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return d[:-2] + 2 * d[1:-1] + d[2:], s[:, :-2] + 2 * s[:, 1:-1] + s[:, 2:]


def test_sobel_and_convolution(spark):
    z = np.random.default_rng(0).normal(size=(1, 7, 9))
    g = stencil.sobel(pixels(spark, [z]))
    gx, gy = sobel_of(z[0])
    assert np.allclose(array(g.withColumn("v", F.col("gx")), (7, 9), "row", "col"), gx) and np.allclose(array(g.withColumn("v", F.col("gy")), (7, 9), "row", "col"), gy)
    w = tiles.gaussian(5)
    p = np.pad(z[0], 2, mode="symmetric")
    assert np.allclose(tiles.separable(p, w), [[np.outer(w, w).ravel() @ p[r : r + 5, c : c + 5].ravel() for c in range(9)] for r in range(7)])


def test_gl_of_equal_images_is_zero(spark):
    px = pixels(spark, trio())
    assert stencil.gl(px, px).first().gl == 0


def test_texture_loss(spark):
    z = np.random.default_rng(0).normal(size=(1, 12, 12))
    px = pixels(spark, [z])
    zone = px.select("scene_id", "row", "col")
    assert stencil.texture_loss(px, px, zone).first().loss == pytest.approx(0)
    assert stencil.texture_loss(px, px.withColumn("v", F.col("v") * 0.5), zone).first().loss == pytest.approx(0.5)


# -- adjustment


def test_global_stage(spark):
    a = trio()
    px, o = pixels(spark, a), overlap.detect(strip(spark, a, 2), 1)
    out, theta = adjust.adjust_global(px, o, 3)
    r = array(out, (3, 4, 4), "scene_id", "row", "col")
    assert np.allclose(r[0], a[0][0])
    assert abs(r[0][:, 2:].mean() - r[1][:, :2].mean()) < 5 and theta.count() == 3
    one, _ = adjust.adjust_global(px.filter("scene_id = 0"), o, 1)
    assert np.allclose(array(one, (4, 4), "row", "col"), a[0][0])
    with pytest.raises(ValueError):
        adjust.adjust_global(px, o.filter("false"), 3)


def test_compensation_solves_a_chain():
    t = adjust.solve_compensation(3, np.array([0, 1]), np.array([1, 2]), np.array([10.0, 7.0]), np.array([16.0, 3.0]), np.array([8.0, 4.0]), 0)
    assert np.allclose(t, [0, -6, -2])
    alone = adjust.solve_compensation(3, np.array([0]), np.array([1]), np.array([1.0]), np.array([2.0]), np.array([1.0]), 0)
    assert alone[2] == pytest.approx(0)


def test_admm_lowers_the_energy():
    rng = np.random.default_rng(1)
    mu, sd = rng.uniform(0.3, 0.7, 6), rng.uniform(0.05, 0.2, 6)
    big, own, rhs = adjust.block_system(mu, sd, np.array([0, 1, 2, 4]), np.array([3, 4, 5, 5]))
    x, ok, _ = adjust.admm(big, own, rhs, 0.5, most=5000, tol=1e-9)
    energy = lambda v: 0.5 * np.sum((big @ v) ** 2) + 0.5 * np.abs(own @ v - rhs).sum()
    assert ok and energy(x) <= energy(np.tile([1.0, 0.0], 6)) + 1e-4


def test_local_stage_brings_constants_together(spark):
    a = [np.full((1, 12, 12), 100.0), np.full((1, 12, 12), 150.0)]
    sc, px = strip(spark, a, 4), pixels(spark, a)
    o = overlap.detect(sc, 1)
    both = adjust.adjust_global(px, o, 2)[0]
    out, b, coef = adjust.adjust_local(both, sc, 1, block=4)
    assert quality.summary(quality.per_pair_band(overlap.sides(out, o)), 1).first().adm < 1.0
    assert b.count() == coef.count() == 18


def plain_local(scenes, step, block, lam, rho, most, tol):
    """The local stage over dense matrices and all blocks at once."""
    valid = np.concatenate([a[np.isfinite(a)] for a in scenes])
    lo, hi = np.percentile(valid, [1, 99])
    held = {}
    for s, a in enumerate(scenes):
        for r, c in np.ndindex(*a.shape):
            if np.isfinite(a[r, c]):
                held.setdefault((r // block, (c + s * step) // block, s), []).append((a[r, c] - lo) / (hi - lo))
    keys = sorted(held)
    mu, sd = np.array([np.mean(held[k]) for k in keys]), np.array([np.std(held[k]) for k in keys])
    t, pairs = len(keys), [(i, j) for i, p in enumerate(keys) for j, q in enumerate(keys) if i < j and p[:2] == q[:2]]
    joint, own = np.zeros((2 * len(pairs), 2 * t)), np.zeros((2 * t, 2 * t))
    for n, (i, j) in enumerate(pairs):
        joint[2 * n, [2 * i, 2 * i + 1, 2 * j, 2 * j + 1]] = mu[i], 1, -mu[j], -1
        joint[2 * n + 1, [2 * i, 2 * j]] = sd[i], -sd[j]
    for k in range(t):
        own[2 * k, 2 * k : 2 * k + 2], own[2 * k + 1, 2 * k] = (mu[k], 1), sd[k]
    want = np.column_stack([mu, sd]).ravel()
    x, z, u = np.tile([1.0, 0.0], t), np.zeros(2 * t), np.zeros(2 * t)
    for _ in range(most):
        was, x = x, np.linalg.solve(joint.T @ joint + rho * own.T @ own, rho * own.T @ (z - u + want))
        gap = own @ x - want
        z = np.sign(gap + u) * np.maximum(abs(gap + u) - lam / rho, 0)
        u = u + gap - z
        if np.linalg.norm(x - was) < tol * np.linalg.norm(was):
            break
    else:
        x = np.tile([1.0, 0.0], t)
    gain, shift = x[0::2], (hi - lo) * x[1::2] + (1 - x[0::2]) * lo
    out = []
    for s, a in enumerate(scenes):
        made = np.full(a.shape, np.nan)
        for r, c in np.ndindex(*a.shape):
            m, n = r / block - 0.5, (c + s * step) / block - 0.5
            mine = [(np.hypot(m - k[0], n - k[1]), e, k) for e, k in enumerate(keys) if k[2] == s]
            near = [d for d in mine if abs(d[2][0] - np.rint(m)) <= 1 and abs(d[2][1] - np.rint(n)) <= 1] or [min(mine)]
            w = np.array([1 / max(d, 1e-10) for d, *_ in near])
            at = [e for _, e, _ in near]
            made[r, c] = w @ gain[at] / w.sum() * a[r, c] + w @ shift[at] / w.sum()
        out.append(made)
    return out


def test_local_stage_equals_a_plain_version(spark):
    rng = np.random.default_rng(7)
    a = [rng.normal(100 + 40 * k, 8 + 3 * k, (12, 14)) for k in range(3)]
    a[0][4:12, 0:8] = np.nan
    a[1][2, 3] = np.nan
    want = plain_local(a, 6, 4, 0.05, 1.0, 3000, 1e-6)
    assert not np.allclose(want[1][~np.isnan(a[1])], a[1][~np.isnan(a[1])], rtol=0.01)
    out, _, coef = adjust.adjust_local(pixels(spark, [x[None] for x in a]), strip(spark, [x[None] for x in a], 6), 1, 4, 0.05, 1.0, 3000, 1e-6)
    assert coef.filter("NOT converged").isEmpty()
    got = array(out, (3, 12, 14), "scene_id", "row", "col")
    assert np.allclose(got, np.array(want), rtol=2e-3, equal_nan=True)


def test_idw_ignores_far_blocks_and_falls_back(spark):
    near = [(3, 3, 1.0), (3, 4, 1.0), (4, 3, 1.0), (0, 0, 100.0), (0, 6, 100.0), (6, 0, 100.0), (6, 6, 100.0)]
    b = spark.createDataFrame([(0, k, m, n) for k, (m, n, _) in enumerate(near)], "scene_id int, block_id long, gm int, gn int")
    c = spark.createDataFrame([(0, k, x, 0.0) for k, (_, _, x) in enumerate(near)], "band int, block_id long, a double, b double")
    at = spark.createDataFrame([(0, 0, 0, 0, 1.0, 3.7, 3.7, 3, 3), (0, 0, 0, 1, 1.0, 1.5, 5.5, 1, 5)], PX + ", fm double, fn double, gm int, gn int")
    got = {r.col: r.a for r in blocks.idw(at, b, c).collect()}
    assert got[0] == pytest.approx(1.0, abs=0.01) and got[1] == pytest.approx(100.0)


def test_baselines(spark):
    base = np.arange(60.0).reshape(1, 6, 10)
    a = [base, base * 2 + 30]
    px, o = pixels(spark, a), overlap.detect(strip(spark, a, 0), 1)
    moved = array(adjust.moment_baseline(px, o, [(0, 1)]), (2, 6, 10), "scene_id", "row", "col")
    assert np.allclose(moved[1], base[0]) and np.allclose(moved[0], base[0])
    hist = array(adjust.histogram_baseline(px, o, [(0, 1)], bins=4096), (2, 6, 10), "scene_id", "row", "col")
    off = np.abs(hist[1] - base[0])
    off[5, 9] = 0  # the greatest value has a share of 1, where the parent's curve is flat: it goes to the top of the joint range
    assert off.max() < 2 and hist[1][5, 9] == pytest.approx(148, abs=0.1) and np.allclose(hist[0], base[0])
    wal = array(adjust.wallis_baseline(px, o, window=3), (2, 6, 10), "scene_id", "row", "col")
    assert np.allclose(wal[0], base[0]) and np.isfinite(wal).all()


# -- mosaics


def test_edt_is_exact(spark):
    ok = np.random.default_rng(5).random((9, 11)) > 0.25
    r, c = np.nonzero(ok)
    got = {(x.gr, x.gc): x.w for x in mosaic.edt(spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(r, c)], "scene_id int, gr int, gc int")).collect()}
    pad = np.pad(ok, 1)
    bad = np.argwhere(~pad) - 1
    for a, b in zip(r, c):
        assert got[a, b] == pytest.approx(np.sqrt(((bad - [a, b]) ** 2).sum(1).min()))


def test_seam_takes_the_cheapest_path():
    rng = np.random.default_rng(2)
    a, b = rng.random((5, 4)), rng.random((5, 4))
    cost = np.abs(a - b)
    best = min(sum(cost[r, p[r]] for r in range(5)) for p in itertools.product(range(4), repeat=5) if all(abs(p[r] - p[r - 1]) <= 1 for r in range(1, 5)))
    seam = mosaic.min_cost_seam(a, b, np.ones((5, 4), bool), np.ones((5, 4), bool), 1.0, 0.0)
    assert sum(cost[r, seam[r]] for r in range(5)) == pytest.approx(best) and (np.abs(np.diff(seam)) <= 1).all()


@pytest.mark.parametrize("mode", ["weighted", "source_selection", "narrow_feather"])
def test_mosaic_of_two_flat_scenes(spark, mode):
    a = [np.full((2, 10, 10), 100.0), np.full((2, 10, 10), 200.0)]
    sc = strip(spark, a, 5)
    grid = mosaic.canvas(sc)
    assert grid.first()["n_cols"] == 15
    out = array(mosaic.make(mosaic.reproject(pixels(spark, a), sc, grid, [0, 1]), mode, 4), (2, 10, 15), "band", "gr", "gc")
    assert np.isfinite(out).all() and np.allclose(out[:, :, :3], 100) and np.allclose(out[:, :, 12:], 200)
    if mode == "weighted":
        assert ((out[:, :, 6:9] > 100) & (out[:, :, 6:9] < 200)).all()


def test_nodata_spreads_over_bands(spark):
    m = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, None), (0, 0, 1, 2.0), (1, 0, 1, 3.0)], "band int, gr int, gc int, v double")
    assert sorted(r.v for r in mosaic.with_nodata(m, 2, -9.0).collect()) == [-9.0, -9.0, 2.0, 3.0]


# -- registration and graphs


def test_phase_shift_finds_a_known_shift():
    rng = np.random.default_rng(7)
    big = rng.random((90, 90))
    for _ in range(2):
        big = (big + np.roll(big, 1, 0) + np.roll(big, 1, 1)) / 3
    ref, tgt = big[10:74, 10:74], big[13:77, 8:72]
    dy, dx, conf = register.phase_shift(ref, tgt)
    assert abs(dy - 3) < 0.3 and abs(dx + 2) < 0.3 and conf > 0.8
    assert register.phase_shift(np.full((5, 5), np.nan), np.zeros((5, 5))) == (0, 0, 0)


def test_warp_moves_a_ramp(spark):
    a = np.tile(np.arange(60.0), (40, 1))[None]
    f = register.constant_field(strip(spark, [a], 0), spark.createDataFrame([(0, 3.0, 0.0)], "scene_id int, dx double, dy double"))
    out = array(register.warp(pixels(spark, [a]), f), (40, 60), "row", "col")
    assert np.allclose(out[:, 3:], np.arange(60.0)[3:] - 3) and np.isnan(out[:, :3]).all()
    near = array(register.warp(pixels(spark, [a]), f, nearest=True), (40, 60), "row", "col")
    assert np.allclose(near[:, 3:], out[:, 3:])


def test_network_adjustment():
    pairs = [{"i": 0, "j": 1, "dx": 2.0, "dy": 1.0, "confidence": 0.9, "n_blocks": 20, "rmse": 0.2}, {"i": 1, "j": 2, "dx": -1.0, "dy": 3.0, "confidence": 0.9, "n_blocks": 20, "rmse": 0.2}, {"i": 0, "j": 2, "dx": 1.0, "dy": 4.0, "confidence": 0.9, "n_blocks": 20, "rmse": 0.2}]
    x, left = graph.network_adjustment(pairs, 3)
    assert np.allclose(x, [[0, 0], [2, 1], [1, 4]], atol=1e-6) and [p["is_tree"] for p in left] == [True, False, True]


def test_spanning_tree_and_parents():
    assert graph.spanning_tree([(0, 1), (1, 2), (2, 3)]) == [(0, 1), (1, 2), (2, 3)]
    assert graph.parents([(0, 1)], 3) == {0: None, 1: 0, 2: None}
    assert adjust.by_levels([(0, 1), (1, 2)], 0) == [[(0, 1)], [(1, 2)]]


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20], "src int, dst int")
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(k, 0 if k <= 20 else 21) for k in range(41)}


def test_register_a_pair(spark):
    rng = np.random.default_rng(7)
    big = rng.random((80, 80))
    for _ in range(2):
        big = (big + np.roll(big, 1, 0) + np.roll(big, 1, 1)) / 3
    a = [big[8:72, 8:72][None], big[10:74, 9:73][None]]
    sc, px = strip(spark, a, 0), pixels(spark, a)
    out = pipeline.registered(px, sc, overlap.detect(sc, 1), 2, block=32)
    r = array(out, (2, 64, 64), "scene_id", "row", "col")
    assert np.nanmean(np.abs(r[1][4:-4, 4:-4] - r[0][4:-4, 4:-4])) < 0.3 * np.abs(a[1][0] - a[0][0]).mean()


def test_splines_and_affines():
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 100, (40, 2))
    v = np.column_stack([0.5 + 0.01 * p[:, 0], np.sin(p[:, 1] / 40)])
    at = register.thin_plate(p, v)
    assert np.allclose(at(p), v, atol=1e-6)
    m, ok = register.fit_affine(p, p @ np.array([[1.01, 0.0], [0.0, 0.99]]) + [2, 3], 100)
    parts = register.affine_parts(m)
    assert ok.all() and parts["scale_x"] == pytest.approx(1.01) and parts["scale_y"] == pytest.approx(0.99) and parts["dx"] == pytest.approx(2)
    cv = register.cross_validate(pd.DataFrame({"x": p[:, 0], "y": p[:, 1], "rdx": v[:, 0], "rdy": v[:, 1]}))
    assert set(cv["model"]) == {"translation", "affine", "spline"} and cv.set_index("model").rmse["spline"] < cv.set_index("model").rmse["translation"]


def test_merged_controls_keep_the_most_confident(spark):
    c = spark.createDataFrame([(0, 0.0, 0.0, 0.1, 0.0, 0.9), (0, 10.0, 0.0, 0.1, 0.0, 0.8), (0, 100.0, 0.0, 0.1, 0.0, 0.7), (0, 200.0, 0.0, 0.1, 0.0, 0.1)], "scene_id int, x double, y double, rdx double, rdy double, conf double")
    assert sorted(r.x for r in register.merged_controls([c]).collect()) == [0.0, 100.0]


def test_field_and_hull(spark):
    cells = spark.range(100).select(F.lit(0).alias("scene_id"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    ctl = pd.DataFrame({"x": [0, 9, 0, 9], "y": [0, 0, 9, 9], "rdx": [1.0] * 4, "rdy": [5.0] * 4})
    f = register.field(cells, ctl)
    assert all(np.hypot(r.dx, r.dy) == pytest.approx(2.5) for r in f.collect())
    hull = diagnostics.convex_hull(np.array([[2, 2], [6, 2], [6, 6], [2, 6], [4, 4]]))
    fade = {(r.row, r.col): r.fade for r in register.hull_fade(cells, hull, 4.0).collect()}
    assert fade[4, 4] == 1 and fade[4, 8] == pytest.approx(0.5) and fade[0, 0] == pytest.approx(1 - np.sqrt(8) / 4)
    steep = diagnostics.field_stats(f, 2.0).first()
    assert steep.n == 100 and steep.clipped == 100
    flat = spark.range(2500).select(F.lit(0).alias("scene_id"), (F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), F.when(F.col("id") == 1275, 9.0).otherwise(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    assert {(r.row, r.col) for r in diagnostics.spikes(flat).collect()} == {(24, 25), (26, 25), (25, 24), (25, 26)}


def test_nearest_control(spark):
    p = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 3.0, 4.0), (0, 3, 50.0, 50.0)], "scene_id int, point_id int, x double, y double")
    assert {r.point_id: r.nn for r in diagnostics.nearest_control(p, 10.0).collect()} == {1: 5.0, 2: 5.0, 3: None}


# -- spectra, seams, rendering


def test_spectral_edges(spark):
    px = spark.createDataFrame([(0, [1.0, 0.0], [0.0, 1.0]), (1, [1.0, 1.0], [2.0, 2.0]), (2, [float("nan"), 1.0], [1.0, 1.0]), (3, [0.0, 0.0], [1.0, 1.0])], "pixel_id int, o array<double>, n array<double>")
    got = {r.pixel_id: r.sam for r in spectral.sam(spectral.usable(px)).collect()}
    assert got[0] == pytest.approx(90) and got[1] == pytest.approx(0, abs=1e-5) and set(got) == {0, 1}
    assert spectral.proportional_sizes({"a": 30, "b": 10}, 8) == {"a": 6, "b": 2}


def test_seam_of_a_step(spark):
    a = pixels(spark, [np.full((1, 4, 12), 10.0)])
    b = pixels(spark, [np.full((1, 4, 12), 25.0)])
    s = seams.middle(a, 12)
    assert seams.reported(seams.jump(a, b, s, 3, 12), "jump").first()["mean"] == 15
    mixed = {(r.width, r.col): r.v for r in seams.feathered(a, b, s, [2]).filter("row = 0").collect()}
    assert mixed[2, 0] == 10 and mixed[2, 11] == 25 and mixed[2, 6] == 17.5


def test_png_and_preview(spark):
    import zlib

    rgb = render.preview(pixels(spark, [np.arange(300.0).reshape(3, 10, 10)]), [0, 1, 2], 2)
    raw = render.png(rgb)
    assert rgb.shape == (5, 5, 3) and raw[:4] == b"\x89PNG" and len(zlib.decompress(raw[raw.index(b"IDAT") + 4 : -16])) == 5 * 16


# -- files, configuration, command line


def test_lzw_round_trip():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"abab" * 5000, rng.integers(0, 256, 30_000, np.uint8).tobytes(), rng.integers(0, 3, 60_000, np.uint8).tobytes()):
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("method", [tiff.NONE, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("dtype", ["float32", "uint16", "int16", "float64"])
def test_tiff_round_trip(method, dtype):
    data = np.random.default_rng(1).integers(0, 2000, (3, 70, 50)).astype(dtype)
    got = tiff.read(tiff.write(tiff.Raster(data, (2.0, 0.0, 5.0, 0.0, -2.0, 9.0), "EPSG:4326", -1.0), method))
    assert (got.data == data).all() and got.affine == (2.0, 0.0, 5.0, 0.0, -2.0, 9.0) and got.crs == "EPSG:4326" and got.nodata == -1.0
    assert (tiff.read(tiff.write(tiff.Raster(data, (1, 0, 0, 0, -1, 0)), method), [1]).data == data[1:2]).all()
    with pytest.raises(ValueError):
        tiff.write(tiff.Raster(np.zeros(3), (1, 0, 0, 0, -1, 0)))


def test_geotiff_scan_and_write(spark, tmp_path):
    data = np.random.default_rng(1).normal(100, 9, (2, 30, 40)).astype("float32")
    data[:, :3] = -9999
    px = pixels(spark, [np.where(data == -9999, np.nan, data)])
    head = spark.createDataFrame([(0, "one", 30, 40, 2, 1.0, 0.0, 0.0, 0.0, -1.0, 30.0, "EPSG:4326", -9999.0)], "scene_id int, name string, n_rows int, n_cols int, n_bands int, a double, b double, c double, d double, e double, f double, crs string, nodata double")
    assert geotiff.write(px, head, f"file://{tmp_path}/sub").first()["bytes"] > 0
    found = geotiff.files(spark, str(tmp_path))
    m = geotiff.metadata(found).first()
    assert (m.n_rows, m.n_cols, m.n_bands, m.crs, m.nodata) == (30, 40, 2, "EPSG:4326", -9999.0)
    back = array(geotiff.pixels(geotiff.tiles(found, size=16)), (2, 30, 40), "band", "row", "col")
    assert np.allclose(back[:, 3:], data[:, 3:]) and np.isnan(back[:, :3]).all()
    paths = spark.createDataFrame([("/a/x_B2.tif",), ("/a/x_B10.tif",), ("/a/x_PAN.tif",)], "path string")
    assert geotiff.groups(geotiff.without_pan(paths)).first()["bands"] == ["/a/x_B2.tif", "/a/x_B10.tif"]
    shapes = spark.createDataFrame([("g", 5, 5), ("g", 5, 5), ("g", 10, 10)], "folder string, n_rows int, n_cols int")
    assert geotiff.common_shape(shapes, "folder").count() == 2


def test_config(tmp_path):
    c = config.sample()
    config.save(c, str(tmp_path / "c.yaml"))
    assert config.load(str(tmp_path / "c.yaml")) == c and config.problems(c, files=False) == []
    assert config.common_bands(c) == ["B01", "B02", "B03", "B04"]
    (tmp_path / "e.yaml").write_text("")
    assert config.load(str(tmp_path / "e.yaml")) == config.Config()
    (tmp_path / "b.yaml").write_text("nonsense: 1\nlocal: {block_size: '50'}\nrgb_bands: [a]\nmethods: [zz]\nscenes: [{id: a, bands: {B1: x}}, {id: a}]\n")
    with pytest.warns(UserWarning):
        bad = config.load(str(tmp_path / "b.yaml"))
    assert bad.local.block_size == 50 and len(config.problems(bad)) == 4


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(4)
    c = config.sample(("a", "b"), 2)
    c.output_dir, c.min_overlap, c.methods, c.local.block_size = str(tmp_path / "out"), 10, ["original", "global"], 4
    for k, s in enumerate(c.scenes):
        for band in s.bands:
            s.bands[band] = str(tmp_path / f"{s.id}_{band}.tif")
            (tmp_path / f"{s.id}_{band}.tif").write_bytes(tiff.write(tiff.Raster(rng.normal(100 + 20 * k, 5, (1, 8, 12)).astype("float32"), (1.0, 0.0, 6.0 * k, 0.0, -1.0, 8.0), "EPSG:4326", None)))
    config.save(c, str(tmp_path / "c.yaml"))
    args = ["--config", str(tmp_path / "c.yaml")]
    assert cli.main([*args, "--dry-run", "multiband"]) == 0
    args += ["--registered"]
    for verb in ("multiband", "seam", "spectral"):
        assert cli.main([*args, verb]) == 0, verb
    got = spark.read.option("header", True).csv(f"{c.output_dir}/metrics/summary")
    ave = {r.method: float(r.adm) for r in got.collect()}
    assert ave["global"] < ave["original"]
    made = {f.stem: f.read_bytes() for f in (tmp_path / "out" / "mosaic").glob("*.png")}
    assert made and made.keys() == {f.stem for f in (tmp_path / "out" / "mosaic").glob("*.tif")} and all(x.startswith(b"\x89PNG") for x in made.values())
    assert cli.main([*args, "--resume", "multiband"]) == 0
    with pytest.raises(SystemExit):
        cli.main([*args, "nothing"])


def _scene_files(folder, sizes, crs="EPSG:4326"):
    """A folder a scene: per band (rows, columns, pixel size) of values that rise by column and row of the ground, from x = 6 times the scene's number."""
    for k, bands in enumerate(sizes):
        (folder / f"s{k}").mkdir(parents=True)
        for b, (rows, cols, res) in enumerate(bands):
            y, x = np.mgrid[0:rows, 0:cols]
            data = (10 * (6 * k + (x + 0.5) * res) + 3 * (y + 0.5) * res)[None].astype("float32")
            (folder / f"s{k}" / f"x_B{b + 1}.tif").write_bytes(tiff.write(tiff.Raster(data, (res, 0.0, 6.0 * k, 0.0, -res, rows * res), crs if isinstance(crs, str) else crs[k], None)))


def test_found_scenes(spark, tmp_path):
    _scene_files(tmp_path / "in", [[(8, 12, 1.0)] * 2, [(8, 12, 1.0)] * 2])
    (tmp_path / "in" / "s0" / "x_PAN9.tif").write_bytes(b"x")
    got = cli.found_scenes(spark, str(tmp_path / "in"))
    assert [(s.id, list(s.bands)) for s in got] == [("s0", ["B01", "B02"]), ("s1", ["B01", "B02"])]
    assert got[0].bands["B02"] == str(tmp_path / "in" / "s0" / "x_B2.tif")
    flat = cli.found_scenes(spark, str(tmp_path / "in" / "s1"))
    assert [(s.id, list(s.bands)) for s in flat] == [("x_B1", ["B01"]), ("x_B2", ["B01"])]
    assert [s.id for s in cli.found_scenes(spark, str(tmp_path / "in"), "S1/x")] == ["s1"]
    (tmp_path / "in" / "s0" / "y_B1.tif").write_bytes(b"x")
    with pytest.raises(ValueError, match="both band B01"):
        cli.found_scenes(spark, str(tmp_path / "in"))


def test_bands_on_one_grid(spark, tmp_path):
    """A band of half the resolution is brought to the registration band's grid; without that strategy, and for other faults, the scan refuses."""
    _scene_files(tmp_path, [[(8, 12, 1.0), (4, 6, 2.0)], [(8, 12, 1.0), (4, 6, 2.0)]])
    c = config.Config(scenes=cli.found_scenes(spark, str(tmp_path)), registration_band="B01", min_overlap=1)
    with pytest.raises(ValueError, match="4 x 6 pixels"):
        cli.scan(spark, c)
    c.common_bands_strategy = "resample_to_registration_grid"
    px, head, bands = cli.scan(spark, c)
    assert bands == [0, 1] and {(r.scene_id, r.n_rows, r.n_cols) for r in head.collect()} == {(0, 8, 12), (1, 8, 12)}
    v = {(r.scene_id, r.band, r.row, r.col): r.v for r in px.collect()}
    assert len(v) == 2 * 2 * 8 * 12 and None not in v.values()
    # Values are linear in place: inside, bilinear resampling gives them back.
    assert all(abs(v[s, 1, r, k] - v[s, 0, r, k]) < 1e-4 for s in (0, 1) for r in range(1, 7) for k in range(1, 11))
    c.registration_band = "B07"
    assert any("B07" in x for x in config.problems(c))
    with pytest.raises(ValueError, match="B07"):
        config.common_bands(c)
    _scene_files(tmp_path / "other", [[(8, 12, 1.0)]] * 2, ["EPSG:4326", "EPSG:32650"])
    with pytest.raises(ValueError, match="different CRS"):
        cli.scan(spark, config.Config(scenes=cli.found_scenes(spark, str(tmp_path / "other"))))


def test_smoke_run(spark, tmp_path):
    _scene_files(tmp_path / "in", [[(8, 12, 1.0)]] * 4)
    c = config.Config(scenes=cli.found_scenes(spark, str(tmp_path / "in")), smoke_scene_count=2, smoke_crop_size=6, min_overlap=1, control_scene=3)
    small = cli.smoke_config(spark, c)
    assert [s.id for s in small.scenes] == ["s1", "s2"] and small.control_scene == 0 and small.smoke
    px, head, _ = cli.scan(spark, small)
    # The overlap is x 12 to 18: its middle is at column 9 of s1 and 3 of s2.
    assert {(r.scene_id, r.c, r.f, r.n_rows, r.n_cols) for r in head.collect()} == {(0, 12.0, 7.0, 6, 6), (1, 12.0, 7.0, 6, 6)}
    got = {(r.scene_id, r.row, r.col): r.v for r in px.collect()}
    assert len(got) == 72 and all(got[0, r, k] == got[1, r, k] for r in range(6) for k in range(6))


def test_control_scene_and_counts(tmp_path):
    text = "scenes: [{id: a, bands: {B1: x}}, {id: b, bands: {B1: y}}]\ncontrol_scene: %s\nscale_scene_counts: [2, 0]\ncommon_bands_strategy: odd\n"
    for said, place in (("auto", 0), ("b", 1), ("1", 1), ("zz", -1)):
        (tmp_path / "c.yaml").write_text(text % said)
        c = config.load(str(tmp_path / "c.yaml"))
        assert c.control_scene == place and len(config.problems(c, files=False)) == (3 if place < 0 else 2)


def test_lone_cells_take_the_nearest_block(spark):
    """Against all blocks at once, ties included."""
    rng = np.random.default_rng(1)
    held = [(int(m), int(n)) for m, n in {(m, n) for m, n in rng.integers(0, 30, (12, 2))}]
    b = spark.createDataFrame([(0, k, m, n) for k, (m, n) in enumerate(held)], "scene_id int, block_id int, gm int, gn int")
    coef = spark.createDataFrame([(0, k, float(k), 0.0) for k in range(len(held))], "band int, block_id int, a double, b double")
    places = [(m, n) for m in range(30) for n in range(30)]
    at = spark.createDataFrame([(0, 0, m, n, 1.0, m + 0.5, n + 0.5, m, n) for m, n in places], "scene_id int, band int, row int, col int, v double, fm double, fn double, gm int, gn int")
    got = {(r.row, r.col): r.a for r in blocks.idw(at, b, coef).collect()}
    lone = [p for p in places if all(max(abs(p[0] - m), abs(p[1] - n)) > 1 for m, n in held)]
    assert len(got) == 900 and len(lone) > 700
    for p in lone:
        best = min(range(len(held)), key=lambda k: (np.hypot(held[k][0] - p[0], held[k][1] - p[1]), held[k]))
        assert got[p] == best


def test_spread_percentiles(spark):
    """As numpy, over many values, ties, one value, two, and none."""
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=5000), 1: rng.integers(0, 4, 3000).astype(float), 2: np.array([5.0]), 3: np.array([1.0, 2.0]), 4: np.array([]), 5: np.repeat([1e9, -1e9], [1, 999])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(g, None) for g in groups]
    q = (0.0, 0.01, 0.02, 0.5, 0.98, 0.99, 1.0)
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    for accuracy in (300, 10_000):
        got = {r.g: r.q for r in spread_percentiles(df, "v", ["g"], *q, accuracy=accuracy).collect()}
        assert set(got) == set(groups) and got.pop(4) is None
        for g, found in got.items():
            assert np.allclose(found, np.percentile(groups[g], 100 * np.array(q)), rtol=1e-12), g
    clash = df.select(F.col("g").alias("b"), F.lit(1).alias("k"), F.col("v").alias("n"))
    assert {r.b: r.q for r in spread_percentiles(clash, "n", ["b", "k"], 0.5).collect()}[3] == [1.5]
    assert spread_percentiles(spark.createDataFrame([], "g int, v double"), "v", ["g"], 0.5).count() == 0


def test_wide_transition(spark):
    """A ramp of 160 columns is measured whole, not cut at 50 columns on either side."""
    px = spark.createDataFrame([(0, k, float(min(max(k - 120, 0), 160))) for k in range(400)], "row int, col int, v double")
    width = seams.transition_width(px, seams.middle(px, 400)).first().width
    assert 155 <= width <= 165


def test_features(spark):
    import json

    r = sinks.features(spark.createDataFrame([(1.0, 2.0, "n")], "x double, y double, name string"), "x", "y").first().value
    assert json.loads(r) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"name": "n"}}


def test_running_quality(spark, tmp_path):
    spark.range(50).selectExpr("cast(id % 2 as int) AS scene_id", "if(id = 7, double('NaN'), double(id)) AS v", "timestamp '2024-01-01 00:10:00' AS ts").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("scene_id int, v double, ts timestamp").parquet(str(tmp_path / "in"))
    q = arrivals.running_quality(s).writeStream.outputMode("complete").format("memory").queryName("rq").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.scene_id: (r.n, r.n_valid) for r in spark.table("rq").collect()} == {0: (25, 25), 1: (25, 24)}


def test_local_solver_by_cells_equals_that_of_a_band(spark):
    """Cells of one to four scenes, bands that converge at other rounds, flat blocks; against dense matrices of the whole band."""
    rng, rows = np.random.default_rng(5), []
    for band in range(3):
        k = 0
        for cell in range(9):
            for scene in sorted(np.random.default_rng(cell).choice(5, 1 + cell % 4, replace=False).tolist()):
                rows.append((scene, cell // 3, cell % 3, band, float(rng.uniform(0.2, 0.8)), 0.0 if (cell, band) == (4, 1) else float(rng.uniform(0.02, 0.3)), k))
                k += 1
    df = spark.createDataFrame(rows, "scene_id int, gm int, gn int, band int, mu double, sigma double, block_id long")
    for tol, most in ((1e-4, 200), (1e-3, 200), (1e-9, 20)):
        got = {(r.band, r.block_id): r for r in adjust.solve_blocks(df, 0.5, 1.0, most, tol).collect()}
        for band in range(3):
            own = [r for r in rows if r[3] == band]
            pairs = [(p[6], q[6]) for p in own for q in own if p[1:3] == q[1:3] and p[0] < q[0]]
            n, b, a, rhs = len(own), np.zeros((2 * len(pairs), 2 * len(own))), np.zeros((2 * len(own), 2 * len(own))), []
            for k, (p, q) in enumerate(pairs):
                b[2 * k, [2 * p, 2 * p + 1, 2 * q, 2 * q + 1]] = own[p][4], 1, -own[q][4], -1
                b[2 * k + 1, [2 * p, 2 * q]] = own[p][5], -own[q][5]
            for k, r in enumerate(own):
                a[2 * k, [2 * k, 2 * k + 1]], a[2 * k + 1, 2 * k] = (r[4], 1), r[5]
                rhs += [r[4], r[5]]
            m, x = b.T @ b + a.T @ a, np.tile([1.0, 0.0], n)
            split, scaled, rhs, ok = np.zeros(2 * n), np.zeros(2 * n), np.array(rhs), False
            for rounds in range(1, most + 1):
                before = x
                x = x + np.linalg.lstsq(m, a.T @ (split - scaled + rhs) - m @ x, rcond=1e-12)[0]
                far = a @ x - rhs + scaled
                split = np.sign(far) * np.maximum(np.abs(far) - 0.5, 0)
                scaled = far - split
                if np.linalg.norm(x - before) < tol * (np.linalg.norm(before) + 1e-12):
                    ok = True
                    break
            for k in range(n):
                r = got[band, k]
                assert (r.converged, r.rounds) == (ok, rounds)
                assert np.allclose((r.a, r.b), x[2 * k : 2 * k + 2] if ok else (1.0, 0.0), atol=1e-6)
