"""GeoTIFF as a Spark data source: spark.read.format("geotiff"), df.write.format("geotiff").

Reading.  Rows are tiles as in operators/tiles.py, with path and nodata; scene_id is the file's place
among the sorted paths.  A partition is one band of one row of tiles of one file, planned from the
headers; filters on path, scene_id, band, tr and r0 choose partitions, so strips and tiles of other
bands and rows are never read.  Option size: the tile size.

Writing.  Rows are tiles with their file's header (name, n_bands, n_rows, n_cols, affine a to f, crs,
nodata).  A file's tiles are uncompressed, so each has a place of its own, known from the header: tasks
write theirs at once, a retried task writes the same bytes again, and no task or driver holds a file.
The commit writes the directory, which lists the tiles that were written, and gives the file its name;
an abort removes what was written.  Options: path (a folder), size, dtype (float32).  The folder's file
system must allow writes at any place of a file (local and network disks do; object stores and HDFS
don't: there, geotiff.write makes a file a task).

register(spark) makes the format known to a session and lets Spark push filters to Python sources.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship
from . import geotiff, tiff

TILES = "path string, scene_id int, band int, tr int, tc int, r0 int, c0 int, h int, w int, nodata double, v binary"
HEAD = ("n_bands", "n_rows", "n_cols", "a", "b", "c", "d", "e", "f", "crs", "nodata")
WRITTEN = ("name", "band", "r0", "c0", "h", "w", "v", *HEAD)
_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in TILES.split(", "))])
_TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return TILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = [c for c in WRITTEN if c not in schema.names]
        if missing:
            raise ValueError(f"columns {missing} are missing")
        return Writer(self.options)


@dataclass
class Window(InputPartition):
    """One band of one row of tiles of a file."""

    path: str
    scene_id: int
    band: int
    tr: int
    r0: int
    h: int


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.size, self.pushed = options["path"], int(options.get("size", geotiff.TILE)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            on = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if on in ("path", "scene_id", "band", "tr", "r0") and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                if type(f) in _TESTS:
                    self.pushed.append(f)
            else:
                yield f

    def wanted(self, **row: object) -> bool:
        """Whether a row passes the pushed filters on its columns."""
        return all(_TESTS[type(f)](row[f.attribute[0]], f.value) for f in self.pushed if f.attribute[0] in row)

    def files(self) -> list[str]:
        """Paths of the folder's TIFF files, or of one file, sorted."""
        import pyarrow.fs as pafs

        if "://" in self.folder:
            fs, at = pafs.FileSystem.from_uri(self.folder)
            head = self.folder[: len(self.folder) - len(at)]
            if fs.get_file_info(at).type == pafs.FileType.File:
                return [self.folder]
            found = [head + x.path for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if x.type == pafs.FileType.File]
        else:
            found = [self.folder] if os.path.isfile(self.folder) else glob.glob(f"{self.folder}/**", recursive=True)
        return sorted(x for x in found if x.lower().endswith((".tif", ".tiff")))

    def partitions(self) -> list[InputPartition]:
        asked = [(k, p) for k, p in enumerate(self.files()) if self.wanted(path=p, scene_id=k)]

        def shape(path: str) -> tuple[int, int]:
            _, t = tiff.tags(geotiff._source(path))
            return t.get(tiff.SAMPLES, (1,))[0], t[tiff.LENGTH][0]

        with ThreadPoolExecutor(16) as pool:
            shapes = list(pool.map(shape, [p for _, p in asked]))
        return [
            Window(p, k, band, r0 // self.size, r0, min(self.size, rows - r0))
            for (k, p), (bands, rows) in zip(asked, shapes)
            for band in range(bands)
            if self.wanted(band=band)
            for r0 in range(0, rows, self.size)
            if self.wanted(tr=r0 // self.size, r0=r0)
        ]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Window):  # no partition at all
            return
        r = tiff.read(geotiff._source(part.path), [part.band], (part.r0, part.r0 + part.h))
        for c0 in range(0, r.data.shape[2], self.size):
            x = r.data[0, :, c0 : c0 + self.size].astype("<f8")
            x = np.where(np.isfinite(x) & ((x != r.nodata) if r.nodata is not None else True), x, np.nan)
            row = (part.path, part.scene_id, part.band, part.tr, c0 // self.size, part.r0, c0, *x.shape, r.nodata, x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)


@dataclass
class Filled(WriterCommitMessage):
    """Of each file a task wrote to: its header and the numbers of the tiles written."""

    files: dict[str, tuple[tuple, list[int]]]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        folder = options["path"].removeprefix("file://")
        if "://" in folder:
            raise ValueError(f"{folder}: tiles need a file system with writes at any place; geotiff.write makes a file a task")
        self.folder, self.size, self.dtype, self.job = folder, int(options.get("size", geotiff.TILE)), options.get("dtype", "float32"), uuid.uuid4().hex[:12]
        if self.size % 16:
            raise ValueError("a TIFF tile's size is a multiple of 16")

    def at(self, name: str) -> str:
        return f"{self.folder}/.{name}.tif.{self.job}"

    def head(self, h: tuple, present: np.ndarray | None = None) -> tuple[bytes, int]:
        bands, rows, cols, *affine, crs, nodata = h
        return tiff.tiled_head(bands, rows, cols, self.size, self.dtype, tuple(affine), crs, nodata, present)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files: dict[str, tuple[tuple, list[int]]] = {}
        starts: dict[str, int] = {}
        os.makedirs(self.folder, exist_ok=True)
        for b in iterator:
            for t in b.select(list(WRITTEN)).to_pylist():
                h = tuple(t[k] for k in HEAD)
                if t["name"] not in files:
                    files[t["name"]], starts[t["name"]] = (h, []), self.head(h)[1]
                if t["r0"] % self.size or t["c0"] % self.size:
                    raise ValueError(f"a tile at {t['r0']}, {t['c0']} isn't one of {self.size} x {self.size}")
                down, across = -(-t["n_rows"] // self.size), -(-t["n_cols"] // self.size)
                k = (t["band"] * down + t["r0"] // self.size) * across + t["c0"] // self.size
                full = np.full((self.size, self.size), np.nan)
                full[: t["h"], : t["w"]] = np.frombuffer(t["v"], "<f8").reshape(t["h"], t["w"])
                if t["nodata"] is not None:
                    full[np.isnan(full)] = t["nodata"]
                raw = full.astype(self.dtype).tobytes()
                fd = os.open(self.at(t["name"]), os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    os.pwrite(fd, raw, starts[t["name"]] + k * len(raw))
                finally:
                    os.close(fd)
                files[t["name"]][1].append(k)
        return Filled(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        made: dict[str, tuple[tuple, list[int]]] = {}
        for m in messages:
            for name, (h, tiles) in (m.files if m else {}).items():
                if made.setdefault(name, (h, []))[0] != h:
                    raise ValueError(f"{name} has two headers")
                made[name][1].extend(tiles)
        for name, (h, tiles) in made.items():
            present = np.zeros(h[0] * -(-h[1] // self.size) * -(-h[2] // self.size), bool)
            present[tiles] = True
            with open(self.at(name), "r+b") as f:
                f.write(self.head(h, present)[0])
                f.flush()
                os.fsync(f.fileno())
            os.replace(self.at(name), f"{self.folder}/{name}.tif")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for path in glob.glob(f"{self.folder}/.*.tif.{self.job}"):
            os.remove(path)
