"""GeoTIFF files as tables: a scan into tiles or pixels, header-only metadata, and a writer.

Files are listed by Spark's binaryFile source.  Where a table has their content, a task decodes one
file at a time; where it has paths alone, headers, bands and row windows are fetched by ranges, a task
at a time for each window, so a file of any size spreads over the cluster.  Tiles bound what a row holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import last_int, to_null
from . import tiff

TILE = 256
TILES = "path string, band int, r0 int, c0 int, h int, w int, nodata double, data array<double>"
HEAD = "path string, n_rows int, n_cols int, n_bands int, a double, b double, c double, d double, e double, f double, crs string, nodata double"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every TIFF below a folder, each path once."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(folder).select("path", "content")


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """path of every TIFF below a folder, without its bytes."""
    return files(spark, folder).select("path")


def _source(path: str, content: bytes | None = None) -> bytes | tiff.Ranged:
    import pyarrow.fs as pafs

    if content is not None:
        return bytes(content)
    if "://" not in path:
        return tiff.Ranged(pafs.LocalFileSystem().open_input_file(path.removeprefix("file:")))
    fs, at = pafs.FileSystem.from_uri(path)
    return tiff.Ranged(fs.open_input_file(at))


def metadata(found: DataFrame) -> DataFrame:
    """One row a file (path, and content or not), from its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for path, content in zip(g["path"], g["content"] if "content" in g else [None] * len(g)):
                _, t = tiff.tags(_source(path, content))
                rows.append((path, t[tiff.LENGTH][0], t[tiff.WIDTH][0], t.get(tiff.SAMPLES, (1,))[0], *tiff.affine_of(t), tiff.crs_of(t), tiff.nodata_of(t)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in HEAD.split(", ")])

    return found.mapInPandas(run, HEAD)


def tiles(found: DataFrame, bands: list[int] | None = None, size: int = TILE) -> DataFrame:
    """Tiles of all bands, or of those named (from 0), of files given with their content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for path, content in zip(g["path"], g["content"]):
                r = tiff.read(bytes(content), bands)
                names = range(r.data.shape[0]) if bands is None else bands
                for k, band in enumerate(names):
                    for r0 in range(0, r.data.shape[1], size):
                        for c0 in range(0, r.data.shape[2], size):
                            part = r.data[k, r0 : r0 + size, c0 : c0 + size].astype(float)
                            yield pd.DataFrame({"path": [path], "band": band, "r0": r0, "c0": c0, "h": part.shape[0], "w": part.shape[1], "nodata": r.nodata, "data": [part.ravel()]})

    return found.mapInPandas(run, TILES)


def window_tiles(found: DataFrame, bands: list[int] | None = None, size: int = TILE) -> DataFrame:
    """The same from paths alone: a row window of a file is a task's unit, and only its strips of these bands are read."""
    heads = metadata(found.select("path")).select("path", "n_bands", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1, F.lit(size))).alias("r0"), F.least(F.lit(size), F.col("n_rows")).alias("h"), "n_rows")
    spread = heads.withColumn("band", F.explode(F.array(*map(F.lit, bands)) if bands is not None else F.sequence(F.lit(0), F.col("n_bands") - 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for path, r0, n_rows, band in zip(g["path"], g["r0"], g["n_rows"], g["band"]):
                r = tiff.read(_source(path), [band], (int(r0), int(min(r0 + size, n_rows))))
                for c0 in range(0, r.data.shape[2], size):
                    part = r.data[0, :, c0 : c0 + size].astype(float)
                    yield pd.DataFrame({"path": [path], "band": band, "r0": r0, "c0": c0, "h": part.shape[0], "w": part.shape[1], "nodata": r.nodata, "data": [part.ravel()]})

    return spread.repartition("path", "r0", "band").mapInPandas(run, TILES)


def pixels(tile_rows: DataFrame) -> DataFrame:
    """path, band, row, col, v: tiles as pixels, invalid ones null."""
    flat = tile_rows.select("path", "band", "r0", "c0", "w", "nodata", F.posexplode("data").alias("k", "x"))
    return flat.select("path", "band", (F.col("r0") + F.expr("k div w")).cast("int").alias("row"), (F.col("c0") + F.expr("k % w")).cast("int").alias("col"), to_null(F.col("x"), F.col("nodata")).alias("v"))


def groups(paths: DataFrame) -> DataFrame:
    """folder, bands (paths in the order of the last integer of their names): a folder of files is one multi-band scene."""
    split = paths.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("name"))
    return split.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(last_int(F.col("name")), F.lit(0)).alias("k"), "path"))), lambda x: x["path"]).alias("bands"))


def of_sensor(paths: DataFrame, sensor: str) -> DataFrame:
    """Paths whose file or folder names the sensor: what a folder of mixed scenes is cut down to."""
    return paths.filter(F.upper("path").contains(sensor.upper()))


def without_pan(paths: DataFrame) -> DataFrame:
    return paths.filter(~F.upper("path").contains("_PAN"))


def common_shape(meta: DataFrame, by: str) -> DataFrame:
    """Files whose shape is the most common of their group, the larger of equals: what drops panchromatic bands."""
    from pyspark.sql import Window as W

    counts = meta.groupBy(by, "n_rows", "n_cols").count()
    first = counts.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.col("count").desc(), F.col("n_rows").desc(), F.col("n_cols").desc()))).filter("k = 1")
    return meta.join(F.broadcast(first.select(by, "n_rows", "n_cols")), [by, "n_rows", "n_cols"])  # a row a group


def write(px: DataFrame, head: DataFrame, folder: str, dtype: str = "float32") -> DataFrame:
    """path, bytes of a GeoTIFF a scene, written by the tasks: px (scene_id, band, row, col, v), head (scene_id, name and HEAD's columns).

    A file is one object in its format, so a scene is one group; a scene must fit a task.
    """
    import pyarrow.fs as pafs

    def run(g: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(h) or not len(g):
            return pd.DataFrame({"path": [], "bytes": []})
        m = h.iloc[0]
        empty = np.nan if pd.isna(m["nodata"]) else m["nodata"]
        data = np.full((int(g["band"].max()) + 1, int(m["n_rows"]), int(m["n_cols"])), empty)
        data[g["band"], g["row"], g["col"]] = g["v"].fillna(empty)
        raw = tiff.write(tiff.Raster(data.astype(dtype), tuple(m[k] for k in "abcdef"), m["crs"], None if pd.isna(m["nodata"]) else m["nodata"]))
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{m['name']}.tif") as f:
            f.write(raw)
        return pd.DataFrame({"path": [f"{path}/{m['name']}.tif"], "bytes": [len(raw)]})

    return px.groupBy("scene_id").cogroup(head.groupBy("scene_id")).applyInPandas(run, "path string, bytes long")
