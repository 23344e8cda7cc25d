import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from rasterloom.operators import tiles
from rasterloom.sources import geotiff, tiff, tiffsource

AFFINE = (2.0, 0.0, 5.0, 0.0, -2.0, 9.0)


@pytest.fixture(scope="module")
def session(spark):
    tiffsource.register(spark)
    return spark


def data(seed, bands=3, rows=70, cols=50):
    x = np.random.default_rng(seed).normal(5, 2, (bands, rows, cols)).astype("float32")
    x[:, 3:9, 4:20] = -9.0
    return x


@pytest.fixture
def folder(tmp_path):
    for k in range(2):
        (tmp_path / f"s{k}.tif").write_bytes(tiff.write(tiff.Raster(data(k), AFFINE, "EPSG:32650", -9.0), tiff.NONE, 8))
    return tmp_path


def arrays(rows, shape):
    out = {}
    for r in rows:
        out.setdefault(r.scene_id, np.full(shape, np.inf))[r.band, r.r0 : r.r0 + r.h, r.c0 : r.c0 + r.w] = tiles.values(r.v, r.h, r.w)
    return out


def test_reads_tiles(session, folder):
    got = arrays(session.read.format("geotiff").option("size", 32).load(str(folder)).collect(), (3, 70, 50))
    for k in range(2):
        assert np.array_equal(got[k], np.where(data(k) == -9, np.nan, data(k)), equal_nan=True)
    one = session.read.format("geotiff").option("size", 32).load(f"file://{folder}/s1.tif").filter("band IN (0, 2) AND tr >= 1 AND tc = 1").collect()
    assert {(r.band, r.tr, r.tc) for r in one} == {(b, t, 1) for b in (0, 2) for t in (1, 2)}
    assert session.read.format("geotiff").load(str(folder)).filter("band = 7").count() == 0


def test_filters_are_pushed(session, folder):
    df = session.read.format("geotiff").option("size", 32).load(str(folder)).filter("band = 1 AND r0 >= 32 AND scene_id = 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan, plan
    assert df.count() == 4


def test_reads_only_the_bytes_asked_for(folder, monkeypatch):
    read = []

    class Counted(tiff.Ranged):
        def __getitem__(self, part):
            read.append(part.stop - (part.start or 0))
            return super().__getitem__(part)

    monkeypatch.setattr(tiff, "Ranged", Counted)
    r = tiffsource.Reader({"path": str(folder), "size": "16"})
    assert list(r.pushFilters([EqualTo(("band",), 1), GreaterThanOrEqual(("r0",), 16), LessThan(("tr",), 3), In(("scene_id",), (1,)), EqualTo(("h",), 3)])) == [EqualTo(("h",), 3)]
    parts = r.partitions()
    assert [(p.scene_id, p.band, p.tr) for p in parts] == [(1, 1, 1), (1, 1, 2)]
    read.clear()
    rows = [x for p in parts for b in r.read(p) for x in b.to_pylist()]
    assert len(rows) == 8
    strips = [n for n in read if n == 8 * 50 * 4]
    assert len(strips) == 4 and sum(read) - sum(strips) < 4000  # two strips a window, and the directory


def header(df, name, shape, nodata=-9.0):
    at = dict(zip("abcdef", AFFINE))
    return df.selectExpr("*", f"'{name}' AS name", f"{shape[0]} AS n_bands", f"{shape[1]} AS n_rows", f"{shape[2]} AS n_cols", *[f"{v}D AS {k}" for k, v in at.items()], "'EPSG:32650' AS crs", f"{nodata}D AS nodata" if nodata is not None else "CAST(NULL AS DOUBLE) AS nodata")


def test_writes_one_file_from_many_tasks(session, folder, tmp_path):
    src = session.read.format("geotiff").option("size", 32).load(str(folder)).filter("scene_id = 1").drop("nodata")
    out = tmp_path / "out"
    header(src, "made", (3, 70, 50)).repartition(7).write.format("geotiff").option("size", 32).mode("append").save(str(out))
    assert os.listdir(out) == ["made.tif"]
    got = tiff.read((out / "made.tif").read_bytes())
    assert np.array_equal(got.data, data(1)) and got.affine == AFFINE and got.crs == "EPSG:32650" and got.nodata == -9.0
    back = arrays(session.read.format("geotiff").option("size", 32).load(str(out)).collect(), (3, 70, 50))[0]
    assert np.array_equal(back, np.where(data(1) == -9, np.nan, data(1)), equal_nan=True)


def test_tiles_never_written_are_nodata(session, folder, tmp_path):
    src = session.read.format("geotiff").option("size", 32).load(str(folder)).filter("scene_id = 0 AND NOT (tr = 1 AND band = 2)").drop("nodata")
    header(src, "some", (3, 70, 50)).write.format("geotiff").option("size", 32).mode("append").save(f"file://{tmp_path}/out")
    got = tiff.read((tmp_path / "out" / "some.tif").read_bytes()).data
    want = data(0)
    want[2, 32:64] = -9.0
    assert np.array_equal(got, want)


def test_a_failed_write_leaves_nothing(session, folder, tmp_path):
    src = session.read.format("geotiff").option("size", 32).load(str(folder)).filter("scene_id = 0").drop("nodata")
    bad = header(src.withColumn("c0", F.when((F.col("tr") == 2) & (F.col("band") == 2), 5).otherwise(F.col("c0")).cast("int")), "bad", (3, 70, 50))
    with pytest.raises(Exception, match="isn't one of"):
        bad.write.format("geotiff").option("size", 32).mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []


def test_large_files_get_wide_offsets(tmp_path):
    """A sparse file of over 4 GB: only its first and last tiles have bytes."""
    rows = cols = 40_000
    n = (-(-rows // 512)) ** 2
    present = np.zeros(n, bool)
    present[[0, n - 1]] = True
    head, first = tiff.tiled_head(1, rows, cols, 512, "float32", AFFINE, "EPSG:4326", None, present)
    at = tmp_path / "big.tif"
    with open(at, "wb") as f:
        f.write(head)
        f.seek(first)
        f.write(np.full((512, 512), 1.5, "<f4").tobytes())
        f.seek(first + (n - 1) * 512 * 512 * 4)
        f.write(np.full((512, 512), 2.5, "<f4").tobytes())
    assert at.stat().st_size > 1 << 32
    with open(at, "rb") as f:
        low = tiff.read(tiff.Ranged(f), [0], (rows - 10, rows))
        assert low.data[0, -1, -1] == 2.5 and low.data[0, 0, 0] == 0 and low.affine == AFFINE and low.crs == "EPSG:4326"
    assert geotiff.TILE == 256


def test_a_scene_that_no_task_holds(session, tmp_path):
    """Tiles made by many tasks, 64 MB of floats; each task's rows are a few tiles."""
    n, size = 16, 256
    made = tiles.mapped(session.range(n * n, numPartitions=32).selectExpr("0 AS scene_id", "0 AS band", f"int(id div {n}) AS tr", f"int(id % {n}) AS tc", f"int(id div {n}) * {size} AS r0", f"int(id % {n}) * {size} AS c0", f"{size} AS h", f"{size} AS w", "X'' AS v"), lambda t: np.add.outer(np.arange(t["r0"], t["r0"] + 256), np.arange(t["c0"], t["c0"] + 256)) / 7)
    header(made, "wide", (1, n * size, n * size), None).write.format("geotiff").mode("append").save(str(tmp_path))
    with open(tmp_path / "wide.tif", "rb") as f:
        part = tiff.read(tiff.Ranged(f), [0], (1000, 1010)).data[0]
    assert np.allclose(part, np.add.outer(np.arange(1000, 1010), np.arange(n * size)) / 7, rtol=1e-6)
