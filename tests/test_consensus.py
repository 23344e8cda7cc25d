import numpy as np
import pytest

from rasterloom.operators import consensus, register

SCHEMA = "i int, j int, key long, x double, y double, u double, v double"


def pair(spark, seed, n, share, i=0, j=1):
    """Matches of an affine with noise, a share of them anywhere."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 1000, (n, 2))
    m = np.array([[1.004, -0.008, 3.0], [0.006, 0.997, -7.0]])
    q = p @ m[:, :2].T + m[:, 2] + rng.normal(0, 0.1, (n, 2))
    off = rng.random(n) < share
    q[off] += rng.uniform(-60, 60, (int(off.sum()), 2))
    return [(i, j, k, *map(float, (*a, *b))) for k, (a, b) in enumerate(zip(p, q))], m, p, q


@pytest.mark.parametrize("n", [12, 60, 900])
def test_finds_the_affine_among_outliers(spark, n):
    rows, m, p, q = pair(spark, n, n, 0.3)
    more, m2, *_ = pair(spark, n + 1, 2 * n, 0.1, 1, 2)
    got = {(r.i, r.j): r for r in consensus.affine_models(spark.createDataFrame(rows + more, SCHEMA), 400).collect()}
    r = got[0, 1]
    found = np.array([[r.a, r.b, r.c], [r.d, r.e, r.f]])
    assert np.allclose(found[:, :2], m[:, :2], atol=2e-3) and np.allclose(found[:, 2], m[:, 2], atol=1.0) and r.n == n
    kept = np.hypot(*(p @ found[:, :2].T + found[:, 2] - q).T) < 0.75
    assert abs(r.inliers - kept.sum()) <= 1 and got[1, 2].inlier_ratio > 0.8
    want = register.affine_parts(found)
    assert all(getattr(r, k) == pytest.approx(want[k], abs=1e-9) for k in ("scale_x", "scale_y", "rotation", "shear"))


def test_refit_equals_least_squares(spark):
    rows, _, p, q = pair(spark, 9, 40, 0.0)
    r = consensus.fitted(spark.createDataFrame(rows, SCHEMA), "i", "j").first()
    want = np.linalg.lstsq(np.column_stack([p, np.ones(40)]), q, rcond=None)[0].T
    assert np.allclose([[r.a, r.b, r.c], [r.d, r.e, r.f]], want, atol=1e-8)


def test_trials_are_spread_and_bounded(spark):
    rows, *_ = pair(spark, 4, 3000, 0.0)
    df = spark.createDataFrame(rows, SCHEMA)
    trials = consensus.trial_models(df, df.groupBy("i", "j").count().withColumnRenamed("count", "n"), 200).collect()
    assert 150 < len(trials) <= 200 and len({r.trial for r in trials}) == len(trials)
    few = consensus.trial_models(df.filter("key < 7"), df.filter("key < 7").groupBy("i", "j").count().withColumnRenamed("count", "n"), 200).collect()
    assert len({(round(r.a, 9), round(r.c, 9)) for r in few}) > 10  # other points each turn


def test_defined_cases(spark):
    line = [(0, 1, k, float(k), 2.0 * k, float(k), 2.0 * k) for k in range(30)]
    few = [(0, 2, k, float(k), float(k * k), 1.0, 2.0) for k in range(2)]
    bad = [(0, 2, 9, None, 1.0, 1.0, 1.0), (0, 2, 8, float("nan"), 1.0, 1.0, 1.0)]
    got = {(r.i, r.j): r for r in consensus.affine_models(spark.createDataFrame(line + few + bad, SCHEMA), 50).collect()}
    for key, n in (((0, 1), 30), ((0, 2), 2)):
        r = got[key]
        assert (r.n, r.inliers, r.a, r.b, r.c, r.d, r.e, r.f) == (n, 0, 1, 0, 0, 0, 1, 0)
    assert consensus.affine_models(spark.createDataFrame([], SCHEMA)).count() == 0


def test_residuals_of_models(spark):
    rows, m, p, q = pair(spark, 5, 200, 0.2)
    df = spark.createDataFrame(rows, SCHEMA)
    shift = consensus.median_shifts(df)
    field = df.selectExpr("i", "j", "key", "u - x AS dx", "v - y + 1 AS dy")
    got = {r.model: r for r in consensus.residuals(df, shift, consensus.affine_models(df, 300), field).collect()}
    d = q - p
    e = np.hypot(*(d - np.median(d, 0)).T)
    r = got["translation"]
    assert np.allclose([r.median, r.p90, r.p95, r.rmse, r.greatest], [*np.percentile(e, [50, 90, 95]), np.sqrt((e**2).mean()), e.max()])
    assert got["affine"].median < 0.3 < r.median and got["field"].median == pytest.approx(1) and got["affine"].n == 200
