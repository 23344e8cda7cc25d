"""Regions and distances of masks on tiles, against plain versions on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import regions, tiles


def plain_labels(mask):
    out, seen = {}, set()
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        todo = [start]
        seen.add(start)
        while todo:
            r, c = todo.pop()
            out[r, c] = start
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n not in seen and 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n]:
                    seen.add(n)
                    todo.append(n)
    return out


def snake(n):
    """One region that winds through the whole raster."""
    m = np.zeros((n, n), bool)
    m[::2] = True
    m[1::4, -1] = m[3::4, 0] = True
    return m


@pytest.mark.parametrize("mask", [np.random.default_rng(0).random((40, 50)) < 0.6, snake(33), np.zeros((3, 3), bool), np.ones((1, 7), bool)])
def test_labels_in_a_tile(mask):
    row, col, root = regions.labels(mask)
    assert {(r, c): (row[k], col[k]) for r, c, k in zip(row, col, root)} == plain_labels(mask)


@pytest.mark.parametrize("reach", [1, 4])
def test_nearest_set(reach):
    x = np.random.default_rng(1).random((30, 22)) < 0.03
    far = regions.nearest_set(np.pad(x, reach), reach)
    at = np.argwhere(x)
    for r in range(30):
        for c in range(22):
            d = np.sqrt(((at - (r, c)) ** 2).sum(1).min())
            assert far[r, c] == (d if d <= reach else np.inf)


def frame(spark, x, size, scene=0):
    rows = [(scene, 0, r, c, float(v)) for (r, c), v in np.ndenumerate(np.asarray(x, float))]
    return tiles.cut(spark.createDataFrame(rows, "scene_id int, band int, row int, col int, v double"), size)


def test_differences_are_one_sided_at_the_border(spark):
    x = np.random.default_rng(2).normal(size=(21, 17))
    want = sum(g**2 for g in np.gradient(x))
    for size in (4, 8, 64):
        got = tiles.pixels(regions.squared_steps(frame(spark, x, size)), g="g").collect()
        assert len(got) == x.size and all(abs(r.g - want[r.row, r.col]) < 1e-12 for r in got)


@pytest.mark.parametrize("size", [5, 8, 64])
def test_regions_cross_tiles(spark, size):
    """A field whose steep cells wind through all tiles gives the regions of the whole array, whatever the tiles."""
    dx = np.where(np.repeat(np.repeat(snake(9), 4, 0), 4, 1), 0.0, 10.0)
    valid = np.random.default_rng(3).random(dx.shape) < 0.9
    ones, none = np.ones_like(dx), np.zeros_like(dx)
    layers = [frame(spark, x, size) for x in (dx, none, valid, ones, none)]
    got = regions.displacement_spikes(*layers, factor=0.0, quantile=0.5, band=2, near_nodata=2, near_hull=2, near_edge=2)
    g = np.sqrt(sum(x**2 for x in np.gradient(dx)))
    mask = valid & (g >= max(np.quantile(g[valid], 0.5), 0.05))
    want = {k: int(regions.cell_id(0, np.array(v[0]), np.array(v[1]))) for k, v in plain_labels(mask).items()}
    rows = got.collect()
    assert {(r.row, r.col): r.region for r in rows} == want and len(set(want.values())) > 1
    n = dx.shape[0] - 1
    assert all(r.kind == ("edge" if min(r.row, r.col, n - r.row, n - r.col) <= 2 else "internal") for r in rows)
    each = {r.region: r.n for r in regions.spike_regions(got).collect()}
    assert each == {k: list(want.values()).count(k) for k in want.values()}


def test_kinds_and_warnings(spark):
    dx = np.zeros((40, 40))
    for r, c in ((20, 20), (3, 30), (30, 1), (12, 20)):
        dx[r, c] = 50.0
    hull, nodata = np.zeros_like(dx), np.zeros_like(dx)
    hull[8:36, 8:36], nodata[:2, 28:33] = 1, 1
    layers = [frame(spark, x, 16) for x in (dx, np.zeros_like(dx), np.ones_like(dx), hull, nodata)]
    got = regions.displacement_spikes(*layers, band=2, near_nodata=4, near_hull=4, near_edge=2)
    kinds = {}
    for r in got.collect():
        kinds.setdefault(min(((20, 20), (3, 30), (30, 1), (12, 20)), key=lambda p: abs(p[0] - r.row) + abs(p[1] - r.col)), set()).add(r.kind)
    assert kinds == {(20, 20): {"internal"}, (3, 30): {"nodata"}, (30, 1): {"edge"}, (12, 20): {"hull"}}
    w = regions.spike_warnings(got).first()
    assert (w.warn, w.internal, w.hull, w.nodata) == (True, 4, 4, 4) and w.steepest.g == 50.0
    still = [frame(spark, x, 16) for x in (np.zeros_like(dx), np.zeros_like(dx), np.zeros_like(dx), hull, nodata)]
    assert regions.displacement_spikes(*still, band=2, near_nodata=4, near_hull=4).count() == 0
    assert got.filter(F.col("to_nodata") > 4).count() == 0
