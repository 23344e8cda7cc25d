import math

import numpy as np
import pytest

from rasterloom.llm import exact_topk
from rasterloom.llm.exact_topk import OP13_SQL, SortedLists, op13_exact_topk, top_k

SCHEMA = "vec_id long, embedding array<float>, rank string"


def plain(rows, k=5, step=50):
    """rows: (vec_id, floats or None), lengths alike.  Components and scores clamp to longs."""
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    ok = [(i, [clamp(math.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % step == 0}):
        qv = min(v for i, v in ok if i == q)
        scored = sorted((-clamp(sum(a * b for a, b in zip(qv, v))), i) for i, v in ok if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def found(spark, rows, **more):
    got = top_k(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), **more).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("dim", [1, 3, 16])
@pytest.mark.parametrize("spread", [2, 9, 4000])
def test_lists_against_all_products(dim, spread):
    rng = np.random.default_rng(dim * spread)
    rows = rng.integers(-spread, spread, (500, dim))
    lists = SortedLists(np.arange(500), rows)
    for _ in range(20):
        q = rng.integers(-spread, spread, dim) * (rng.random(dim) < 0.7)
        lo = int(rng.integers(0, 490))
        got, score, depth = lists.top(q, 7, lo, lo + 3)
        want = sorted((-int(rows[i] @ q), i) for i in range(500) if not lo <= i < lo + 3)[:7]
        assert list(zip([-s for s in score], got.tolist())) == want and depth <= 500


def test_stops_early_where_few_dimensions_count():
    rng = np.random.default_rng(3)
    rows = rng.integers(-3, 3, (20_000, 16))
    rows[:, 4] = rng.integers(-5000, 5000, 20_000)
    q = np.ones(16, np.int64)
    _, score, depth = SortedLists(np.arange(20_000), rows).top(q, 5)
    assert score == sorted((rows @ q).tolist(), reverse=True)[:5] and depth < 500


def test_bound_holds_for_all_rows_not_met():
    rng = np.random.default_rng(4)
    rows = rng.integers(-50, 50, (300, 6))
    lists, q = SortedLists(np.arange(300), rows), rng.integers(-9, 9, 6)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    for depth in (1, 10, 80):
        met = {*lists.places[up, 300 - depth :].ravel().tolist(), *lists.places[down, :depth].ravel().tolist()}
        assert max(int(rows[i] @ q) for i in range(300) if i not in met) <= lists.bound(q, up, down, depth)


def test_query_against_sql(spark, against_sql):
    against_sql(op13_exact_topk, OP13_SQL, "/root/testdata/sf0.01")


def test_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(700)]
    monkeypatch.setattr(exact_topk, "BLOCK", 13)
    assert found(spark, rows) == plain(rows)


def test_defined_cases(spark):
    v = [0.5, -0.25, 0.0]
    rows = [(0, v), (50, v), (50, [0.1, 0.1, 0.1]), (1, v), (2, v), (2, v), (3, None), (4, [0.1, None, 0.2]), (5, [math.inf, 0.0, 0.0]), (6, [math.nan, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (None, v), (100, [0.0, 0.0, 0.0]), (-50, [1e20, -1e20, 3.0]), (9, [1e-9, -1e-9, 0.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [*rows, (11, [1.0]), (12, [])]) == plain(rows)
    assert found(spark, [(0, v)]) == [] and found(spark, [(1, v), (2, v)]) == [] and found(spark, []) == []
    assert found(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]
