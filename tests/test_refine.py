"""Registration's second passes and validations, ranged reads, resumed runs."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_rasters import SC, array, pixels, strip

from rasterloom.operators import graph, mosaic, overlap, refine, register, render
from rasterloom.plans import cli, config
from rasterloom.sources import geotiff, sinks, synthetic, tiff


def shifted_pair(spark, dy=1, dx=2, size=64):
    a = [r.data for r in synthetic.scenes(2, size, size, 0, shifts=[(0, 0), (dy, dx)], seed=7)]
    sc, px = strip(spark, a, 0), pixels(spark, a)
    return px, sc, overlap.detect(sc, 1)


def test_refined_shifts_find_what_is_left(spark):
    px, sc, o = shifted_pair(spark)
    got, log = refine.refined_shifts(px, sc, o, {0: (0.0, 0.0), 1: (1.0, 0.0)}, block=32)
    assert log[0]["accepted"] and abs(got[1][0] - 2) < 0.2 and abs(got[1][1] - 1) < 0.2 and got[0] == (0.0, 0.0)
    same, log = refine.refined_shifts(px, sc, o, {0: (0.0, 0.0), 1: (2.0, 1.0)}, block=32)
    assert not log[0]["accepted"] and same[1] == (2.0, 1.0)


def test_multiscale_and_rematch(spark):
    px, _, o = shifted_pair(spark)
    m = refine.multiscale_matches(overlap.joint(px, o), (32, 24))
    assert {r.block for r in m.select("block").distinct().collect()} == {24, 32}
    best = refine.rematch(m).first()
    assert abs(best.dx - 2) < 0.2 and abs(best.dy - 1) < 0.2 and best.n_blocks >= 5 and best.used == 0.5
    assert refine.rematched(m, refine.rematch(m)).count() == best.n_blocks


def test_grid_blocks_are_full(spark):
    a = [np.arange(30 * 20, dtype=float).reshape(1, 30, 20)] * 2
    sc = strip(spark, a, 0)
    cells = refine.grid_blocks(overlap.joint(pixels(spark, a), overlap.detect(sc, 1)), 8, 5, 3)
    got = {(r.br, r.bc): r["count"] for r in cells.groupBy("br", "bc").count().collect()}
    want = {(i, j) for i in range(30) for j in range(20) if 3 + 5 * i + 8 <= 30 and 3 + 5 * j + 8 <= 20}
    assert set(got) == want and set(got.values()) == {64}


def test_independent_grid_and_holdout(spark):
    px, sc, o = shifted_pair(spark)
    moved = register.warp(px, register.constant_field(sc, spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 1.0)], "scene_id int, dx double, dy double")))
    training = spark.createDataFrame([(0, 1, 12.0, 12.0)], "i int, j int, x double, y double")
    blocks = refine.independent_grid(overlap.joint(moved, o), training, 16, 8, 4, 10.0)
    rows = blocks.collect()
    assert all((r.reason == "near training") == (np.hypot(r.centre_x - 12, r.centre_y - 12) < 10) for r in rows)
    s = refine.validation_summary(blocks, 5).first()
    assert s.n_blocks == len(rows) and s.n_accepted == sum(r.reason is None for r in rows) and s.median < 0.3 and s.failure is None
    m = register.block_matches(overlap.joint(px, o), 16).filter("confidence > 0.5 AND abs(dx) < 5 AND abs(dy) < 5").toPandas()
    out = refine.holdout(px, sc, o, m, groups=3, folds=3, block=16, step=8, least=20)
    assert len(out) == 3 and out["failure"].isna().all() and (out["median"] < 0.5).all() and set(out["threshold"]) <= {0.5, 0.4, 0.3}
    assert refine.holdout(px, sc, o, m.head(3)).empty


def test_corrections(spark):
    e = spark.createDataFrame([(0, 3, 0.5, 0.0, 0.2, 10, 0.8), (1, 3, 1.0, 0.5, 0.4, 10, 0.8), (1, 2, 9.0, 0.0, 0.2, 9, 0.9)], "i int, j int, dx double, dy double, rmse double, n_blocks int, confidence double")
    got = refine.two_edge_correction(e).collect()
    assert len(got) == 1 and got[0].j == 3 and abs(got[0].dx - (0.5 * 40 + 1.0 * 20) / 60) < 1e-9


def test_windowed_shift_and_patches(spark):
    g = synthetic.ground(80, 80, 3, 6)
    dy, dx, conf = refine.windowed_shift(g[8:72, 8:72] - g.mean(), g[6:70, 11:75] - g.mean())
    assert abs(dy - 2) < 0.6 and abs(dx + 3) < 0.6 and 1 <= conf <= 10
    assert refine.windowed_shift(np.full((4, 4), np.nan), np.zeros((4, 4))) == (0, 0, 0)
    px, _, o = shifted_pair(spark, 0, 0)
    got = refine.patch_shifts(overlap.joint(px, o), 32).collect()
    assert len(got) == 4 and all(abs(r.dx) < 0.5 and abs(r.dy) < 0.5 for r in got)


def test_trees_of_dense_strip_and_long_graphs(spark):
    for n, near in ((9, 9), (12, 5), (200, 1)):
        edges = [(a, b) for a in range(n) for b in range(a + 1, min(n, a + near + 1))]
        got = [(r.parent, r.child, r.level) for r in graph.tree_levels(spark.createDataFrame(edges, "i int, j int")).collect()]
        assert [g[:2] for g in got] == graph.spanning_tree(edges) and len(got) == n - 1
        assert all(level == -(-c // near) for _, c, level in got)


def test_seam_follows_sobel_cost():
    a, b = np.zeros((5, 7)), np.zeros((5, 7))
    b[:, 5:] = 10  # the values part here; a Sobel difference of 40 reaches one column further
    ok = np.ones((5, 7), bool)
    want = np.abs(a - b)
    want[:, 4:6] += 0.5 * 40
    assert (mosaic.min_cost_seam(a, b, ok, ok) == 0).all() and want[0].argmin() == 0
    ok[:, 0:4] = False
    ok[1:, 4] = False
    ok[2:, 5] = False
    ok[:2, 6] = False
    assert set(mosaic.min_cost_seam(a, b, ok, ok)) <= {4, 5, 6}
    few = np.zeros((5, 7), bool)
    few[:3, 2] = True
    assert (mosaic.min_cost_seam(a, b, few, few) == 2).all()


def test_ranged_reads_touch_only_what_is_asked(tmp_path, spark):
    data = np.random.default_rng(0).normal(100, 5, (3, 300, 40)).astype("float32")
    (tmp_path / "x.tif").write_bytes(tiff.write(tiff.Raster(data, (1.0, 0.0, 0.0, 0.0, -1.0, 300.0), "EPSG:4326", None)))

    class Counted(tiff.Ranged):
        n = 0

        def __getitem__(self, part):
            Counted.n += part.stop - (part.start or 0)
            return super().__getitem__(part)

    with open(tmp_path / "x.tif", "rb") as f:
        r = tiff.read(Counted(f), [1], (100, 120))
    assert np.array_equal(r.data[0], data[1, 100:120]) and Counted.n < 0.2 * (tmp_path / "x.tif").stat().st_size
    found = geotiff.paths(spark, str(tmp_path))
    got = array(geotiff.pixels(geotiff.window_tiles(found, [2], 64)), (300, 40), "row", "col")
    assert np.allclose(got, data[2])


def test_multiband_registers_and_resumes(spark, tmp_path):
    c = config.sample(("a", "b"), 2)
    c.output_dir, c.min_overlap, c.methods, c.local.block_size = str(tmp_path / "out"), 10, ["original", "global"], 16
    for s, r in zip(c.scenes, synthetic.scenes(2, 64, 64, 16, gains=(1.0, 1.1), shifts=((0, 0), (1, 2)), n_bands=2)):
        for k, band in enumerate(s.bands):
            s.bands[band] = str(tmp_path / f"{s.id}_{band}.tif")
            (tmp_path / f"{s.id}_{band}.tif").write_bytes(tiff.write(tiff.Raster(r.data[k : k + 1], r.affine, r.crs, r.nodata)))
    config.save(c, str(tmp_path / "c.yaml"))
    args = ["--config", str(tmp_path / "c.yaml")]
    assert cli.main([*args, "multiband"]) == 0
    moved = spark.read.parquet(f"{c.output_dir}/steps/registered")
    both = moved.filter("band = 0 AND v IS NOT NULL").withColumn("x", F.col("col") + 16 * F.col("scene_id")).groupBy("row", "x").agg(F.count("v").alias("n"), (F.max("v") - F.min("v")).alias("gap")).filter("n = 2")
    assert both.agg(F.avg("gap")).first()[0] < 330  # the gain alone makes 100 to 300; unregistered it is far more
    files = sorted(p.name for p in (tmp_path / "out" / "mosaic").glob("*.tif"))
    assert files == ["global_weighted_0.tif", "original_weighted_0.tif"]
    r = tiff.read((tmp_path / "out" / "mosaic" / files[0]).read_bytes())
    assert r.data.shape == (2, 64, 80) and r.crs == "EPSG:32650"
    (tmp_path / "out" / ".checkpoints" / "multiband.done").unlink()
    (tmp_path / "out" / ".checkpoints" / "metrics.done").unlink()
    before = (tmp_path / "out" / ".checkpoints" / "registered.done").stat().st_mtime_ns
    assert cli.main([*args, "--resume", "multiband"]) == 0
    assert (tmp_path / "out" / ".checkpoints" / "registered.done").stat().st_mtime_ns == before
    assert (tmp_path / "out" / ".checkpoints" / "metrics.done").exists() and (tmp_path / "out" / "run.log").exists()
    assert {p.name for p in (tmp_path / "out" / "metrics").iterdir()} >= {"summary", "quality", "sam_global", "structure_global"}


def test_alignment_validate_and_sensors(spark, tmp_path):
    c = config.sample(("a", "b"), 1)
    c.output_dir, c.min_overlap, c.methods, c.local.block_size = str(tmp_path / "out"), 10, ["original", "global"], 16
    for s, r in zip(c.scenes, synthetic.scenes(2, 64, 64, 16, gains=(1.0, 1.1), shifts=((0, 0), (1, 2)))):
        s.sensor = "X1"
        for band in s.bands:
            s.bands[band] = str(tmp_path / f"{s.id}_{band}.tif")
            (tmp_path / f"{s.id}_{band}.tif").write_bytes(tiff.write(r))
    config.save(c, str(tmp_path / "c.yaml"))
    args = ["--config", str(tmp_path / "c.yaml"), "--patch", "32"]
    for verb in ("validate", "alignment", "sensors"):
        assert cli.main([*args, verb]) == 0, verb
    assert all(json.loads((tmp_path / "out" / "validation.json").read_text())["held"].values())
    pair = spark.read.option("header", True).csv(f"{c.output_dir}/alignment/pairs").first()
    assert int(pair.n) == 2
    assert {r.sensor for r in spark.read.option("header", True).csv(f"{c.output_dir}/sensors").collect()} == {"X1"}


def test_crops(spark):
    a = [r.data for r in synthetic.scenes(1, 40, 50, n_bands=3)]
    px = pixels(spark, a)
    both = render.comparison_crop({"a": px, "b": px.withColumn("v", F.col("v") + 1)}, [0, 1, 2], 0, 4, 6, 16)
    assert both.shape == (16, 36, 3) and both[:, :16].max() == 255 and (both[:, 16:20] == 255).all()
    seam = spark.createDataFrame([(k, 25) for k in range(40)], "row int, sc int")
    out = render.seam_crop(px.select("band", F.col("row").alias("gr"), F.col("col").alias("gc"), "v"), seam, [0, 1, 2], 16)
    assert (out[:, 8] == (255, 0, 0)).all()


def test_records_hold_no_nan(tmp_path):
    sinks.record(str(tmp_path), "r", {"a": float("nan"), "b": [1.5, float("inf")], "c": np.float64(2)})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": [1.5, None], "c": 2.0}
