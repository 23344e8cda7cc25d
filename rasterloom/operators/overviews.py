"""Overview pyramids of tiled rasters: each level halves the one before.

A cell of level k is the mean of the valid pixels in a square of 2^k pixels' side, weighed by their
number, so it is the mean of the pixels themselves whatever level it was made from.  Tiles of an even
size halve by themselves; four halves make a tile of the next level, by one shuffle of a quarter of the
level's bytes (twice that with the counts).  Levels are kept, so every preview and stretch reads the one it needs.
Where tiles are made from a row each and hold whole cells of a level, cells() makes that level in the tasks that make the tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import kept
from .tiles import BOX, KEY, SIZE, Made, made_pixels, values
from .tiles import stored as as_bytes

LEVEL = "scene_id int, band int, tr int, tc int, r0 int, c0 int, h int, w int, v binary, n binary"
_NAMES = [x.split()[0] for x in LEVEL.split(", ")]
_TYPES = [*[pa.int32()] * 8, pa.binary(), pa.binary()]


def halved_cells(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and counts of 2 x 2 cells, from those of single ones; the last row and column may stand alone."""
    pad = [(0, k % 2) for k in v.shape]
    n = np.pad(n, pad)
    s = np.pad(np.nan_to_num(v), pad) * n
    four = lambda x: x[::2, ::2] + x[1::2, ::2] + x[::2, 1::2] + x[1::2, 1::2]
    count = four(n)
    return np.where(count > 0, four(s) / np.where(count > 0, count, 1), np.nan), count


def _row(t: dict, r0: int, c0: int, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    row = (t["scene_id"], t["band"], t["tr"], t["tc"], r0, c0, *v.shape, as_bytes(v), as_bytes(n))
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _TYPES)], _NAMES)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.to_pylist():
            v = values(t["v"], t["h"], t["w"])
            n = (~np.isnan(v)).astype(float) if t.get("n") is None else values(t["n"], t["h"], t["w"])
            yield _row({**t, "tr": t["tr"] // 2, "tc": t["tc"] // 2}, t["r0"] // 2, t["c0"] // 2, *halved_cells(v, n))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in b.to_pylist():
            r0, c0 = min(p["r0"] for p in t["parts"]), min(p["c0"] for p in t["parts"])
            h, w = max(p["r0"] + p["h"] for p in t["parts"]) - r0, max(p["c0"] + p["w"] for p in t["parts"]) - c0
            v, n = np.full((h, w), np.nan), np.zeros((h, w))
            for p in t["parts"]:
                at = slice(p["r0"] - r0, p["r0"] - r0 + p["h"]), slice(p["c0"] - c0, p["c0"] - c0 + p["w"])
                v[at], n[at] = values(p["v"], p["h"], p["w"]), values(p["n"], p["h"], p["w"])
            yield _row(t, r0, c0, v, n)


def halved(tiles: DataFrame) -> DataFrame:
    """The next level of tiles, or of a level (tiles with n, the counts of valid pixels)."""
    held = [*KEY, *BOX, "v", *(["n"] if "n" in tiles.columns else [])]
    halves = tiles.select(*held).mapInArrow(_halves, LEVEL)
    met = halves.groupBy(*KEY).agg(F.collect_list(F.struct(*BOX, "v", "n")).alias("parts"))
    return met.mapInArrow(_whole, LEVEL)


def pyramid(tiles: DataFrame, levels: int, size: int = SIZE) -> list[DataFrame]:
    """Levels 1 to levels, each kept; tiles have an even size."""
    if size % 2:
        raise ValueError("tiles of an odd size can't be halved")
    out = []
    for _ in range(levels):
        tiles = kept(halved(tiles))
        out.append(tiles)
    return out


def _cells(side: int):  # noqa: ANN202
    def kernel(x: np.ndarray) -> np.ndarray:
        k, n = len(x), x.shape[1] // side
        parts = (k, n, side, n, side)
        ok = ~np.isnan(x)
        count = ok.reshape(parts).sum(axis=(2, 4))
        mean = np.where(ok, x, 0.0).reshape(parts).sum(axis=(2, 4)) / np.where(count > 0, count, 1)
        return np.where(count > 0, mean, np.nan)

    return kernel


def cells(raster: Made, level: int) -> DataFrame:
    """scene_id, band, row, col, v of one level, null where invalid, from tiles that hold whole cells: nothing is shuffled but the tiles' rows."""
    side = 2**level
    if raster.size % side:
        raise ValueError(f"tiles of {raster.size} hold no whole cells of {side}")
    return made_pixels(raster, _cells(side), raster.size // side)


def level_for(rows: int, cols: int, most: int) -> int:
    """The first level whose longer side has at most so many cells."""
    k = 0
    while -(-max(rows, cols) // 2**k) > most:
        k += 1
    return k
