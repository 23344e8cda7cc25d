"""Seam reports of several overlaps and bands, against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import overlap, seamreport
from rasterloom.plans import catalog
from rasterloom.sources import virtual as vr


def test_windows_whatever_columns_are_read(spark):
    """Each column of the overlaps is the same read alone as with all others."""
    d = "/root/testdata/sf0.001"
    whole = {(r.i, r.j): r.asDict() for r in overlap.detect(vr.grid_scenes(spark, d), 1, cell=16.0).collect()}
    for cols in (["i_c0"], ["i_c1"], ["j_c0", "j_c1"], ["i_r1"], ["i_c0", "i_c1"]):
        some = overlap.detect(vr.grid_scenes(spark, d), 1, cell=16.0).select("i", "j", *cols).collect()
        assert len(some) == len(whole) and all(whole[r.i, r.j][c] == r[c] for r in some for c in cols)
    width = overlap.detect(vr.grid_scenes(spark, d), 1, cell=16.0).select("i", "j", (F.col("i_c1") - F.col("i_c0")).alias("n")).collect()
    assert all(r.n == 24 - 6 * (r.j - r.i) for r in width)


def test_reports_of_pairs_and_bands(spark):
    rng = np.random.default_rng(6)
    x = {(i, j, b): (rng.normal(50, 9, (7, n)), rng.normal(60, 9, (7, n))) for i, j, n in ((0, 1, 16), (1, 4, 9)) for b in (0, 1)}
    for one, _ in x.values():
        one[2, 3] = one[5, one.shape[1] // 2 - 1] = np.nan
    rows = [(i, j, b, r, c, *(None if np.isnan(v[r, c]) else float(v[r, c]) for v in p)) for (i, j, b), p in x.items() for r in range(7) for c in range(p[0].shape[1])]
    aligned = spark.createDataFrame(rows, "i int, j int, band int, r int, c int, vi double, vj double")
    overlaps = spark.createDataFrame([(0, 1, 0, 7, 2, 18), (1, 4, 3, 10, 0, 9)], "i int, j int, i_r0 int, i_r1 int, i_c0 int, i_c1 int")
    got = {(r.i, r.j, r.band, r.measure): r for r in seamreport.reports(aligned, overlaps, 4).collect()}
    for (i, j, b), (p, q) in x.items():
        s = p.shape[1] // 2
        jump = np.abs(np.nanmean(p[:, s - 4 : s], 1) - q[:, s : s + 4].mean(1))
        gap = np.abs(np.abs(p[:, s] - p[:, s - 1]) - np.abs(q[:, s + 1] - q[:, s]))
        for name, want in (("jump", jump), ("gap", gap[~np.isnan(gap)])):
            r = got[i, j, b, name]
            assert r.n == len(want) and np.allclose([r.mean, r.median, r.greatest], [want.mean(), np.median(want), want.max()])
    for i, j in ((0, 1), (1, 4)):
        s = x[i, j, 0][0].shape[1] // 2
        far = np.sqrt(sum((x[i, j, b][0][:, s - 1] - x[i, j, b][1][:, s + 1]) ** 2 for b in (0, 1)))
        r = got[i, j, None, "colour"]
        assert r.n == np.isfinite(far).sum() < 7 and np.isclose(r["mean"], np.nanmean(far))
    assert seamreport.reports(aligned.filter("false"), overlaps, 4).count() == 0
    table = {(r.i, r.j, r.band, r.width): r for r in seamreport.sweep(aligned, overlaps, [2, 6]).collect()}
    p, q = x[0, 1, 0]
    w = np.clip(0.5 + (np.arange(16) - 8) / 4, 0, 1)
    v = np.where(np.isnan(p), q, (1 - w) * p + w * q)
    assert np.isclose(table[0, 1, 0, 2]["mean"], v.mean()) and np.isclose(table[0, 1, 0, 2].sd, v.std()) and len(table) == 8


def test_registered_queries_cover_all_overlaps(spark):
    d = "/root/testdata/sf0.001"
    pairs = {(r.i, r.j) for r in overlap.detect(vr.grid_scenes(spark, d), 1, cell=16.0).collect()}
    assert {(r.i, r.j) for r in catalog.QUERIES["seam_reports"](spark, d).collect()} == pairs
