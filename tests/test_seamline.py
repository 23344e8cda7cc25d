import numpy as np
import pytest

from rasterloom.operators import seamline


def plain(cost):
    """The leftmost least path of integer costs, line by line."""
    total, back = [list(map(int, cost[0]))], []
    for row in cost[1:]:
        last, now, ways = total[-1], [], []
        for c, x in enumerate(row):
            p = min((p for p in (c - 1, c, c + 1) if 0 <= p < len(row)), key=lambda p: (last[p], p))
            now.append(last[p] + int(x))
            ways.append(p)
        total.append(now)
        back.append(ways)
    path = [min(range(len(total[-1])), key=lambda c: (total[-1][c], c))]
    for ways in reversed(back):
        path.append(ways[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("high", [2, 5, 10**9])
@pytest.mark.parametrize("strips", [(1, 1, 1), (3, 5, 2, 4), (7, 1, 9), (2, 30)])
def test_transfers_give_the_plain_path(high, strips):
    """Costs of few values, so that ties abound; overlaps cut anywhere."""
    rng = np.random.default_rng(high + len(strips))
    for w in (1, 2, 6, 11):
        cost = rng.integers(0, high, (sum(strips), w))
        cuts = np.split(cost, np.cumsum(strips)[:-1])
        made, v, starts = None, None, []
        for c in cuts:
            t = seamline.transfer(c)
            made = t if made is None else seamline.joined(made, t)
            starts.append(v)
            v = seamline.passed(v, t)
        assert np.array_equal(v, seamline.passed(None, made)) and np.array_equal(v, seamline.steps(cost, None)[0])
        place, path = int(v.argmin()), []
        for c, start in zip(cuts[::-1], starts[::-1]):
            part, place = seamline.followed(seamline.steps(c, start)[1], place)
            path = part.tolist() + path
        assert path == plain(cost)


def overlap(seed, h, w, holes, tied):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 3, (h, w)).astype(float) if tied else rng.normal(0, 1, (h, w)) for _ in "ab")
    gone = rng.random((h, w)) < holes
    a[gone] = np.nan
    a[0, 0] = b[0, 0] = a[-1, -1] = b[-1, -1] = 1.0  # the box is the array
    return a, b


@pytest.mark.parametrize("strip,fan", [(4, 2), (7, 3), (64, 8)])
def test_seams_of_pairs_equal_those_of_arrays(spark, strip, fan):
    shapes = [(25, 9, 0.1, True), (9, 31, 0.3, False), (12, 12, 0.0, True), (30, 3, 0.9, False), (40, 5, 0.6, True)]
    rows, want = [], set()
    for j, (h, w, holes, tied) in enumerate(shapes, 1):
        a, b = overlap(j, h, w, holes, tied)
        ok = ~np.isnan(a) & ~np.isnan(b)
        rows += [(0, j, int(r) + 5, int(c) - 3, float(a[r, c]), float(b[r, c])) for r, c in zip(*np.nonzero(ok))]
        flat = w > h
        x, y, m = (z.T if flat else z for z in (a, b, ok))
        x, y = np.where(m, x, 0.0), np.where(m, y, 0.0)
        line, side = (-3, 5) if flat else (5, -3)
        want |= {(0, j, flat, line + k, side + int(s), min(h, w), int(ok.sum())) for k, s in enumerate(seamline.min_cost_seam(x, y, m, m))}
    both = spark.createDataFrame(rows, "i int, j int, gr int, gc int, va double, vb double")
    assert {tuple(r) for r in seamline.seams(both, strip, fan).collect()} == want
    assert seamline.seams(both.filter("false"), strip, fan).count() == 0
