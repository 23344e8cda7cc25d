"""Regions of raster masks, distances to masks, and where a displacement field breaks.

A mask's regions are labelled inside each tile by itself; only cells on tile borders meet their
neighbours, and the few labels that touch there are joined as a graph.  So no group is a scene, and what
is shuffled after the tiles' own joins are the mask's cells, not the raster's.

Distances are exact up to a reach, which is the halo of a tile, and infinite beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import kept, small, spread_percentiles
from . import graph, tiles

#: A cell's number over all scenes: rows and columns below 2^24, scenes below 2^15.
BITS = 24
_PLACE = ("scene_id", "tr", "tc")


def cell_id(scene: np.ndarray | int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return (np.int64(scene) << 2 * BITS) | (row.astype(np.int64) << BITS) | col.astype(np.int64)


def labels(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, col and label of a mask's set cells: of cells joined by their sides, the place of the first in row order."""
    row, col = np.nonzero(mask)
    at = np.full(mask.shape, -1)
    at[row, col] = np.arange(row.size)
    a = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()])
    b = np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    on = (a >= 0) & (b >= 0)
    a, b, root = a[on], b[on], np.arange(row.size)
    while a.size:
        lower = np.minimum(root[a], root[b])
        new = root.copy()
        # A cell's root takes the least root around it; then every cell takes its root's root.
        np.minimum.at(new, root[a], lower)
        np.minimum.at(new, root[b], lower)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return row, col, root


def nearest_set(x: np.ndarray, reach: int) -> np.ndarray:
    """The distance of each cell inside a margin of `reach` to the nearest set cell of x, infinite beyond reach."""
    h, w = x.shape[0] - 2 * reach, x.shape[1] - 2 * reach
    down = np.full((h, x.shape[1]), np.inf)
    for d in range(reach, -1, -1):
        down[x[reach - d : reach - d + h] | x[reach + d : reach + d + h]] = d * d
    best = np.full((h, w), np.inf)
    for e in range(-reach, reach + 1):
        np.minimum(best, down[:, reach + e : reach + e + w] + e * e, out=best)
    return np.where(best <= reach * reach, np.sqrt(best), np.inf)


def distances(masks: DataFrame, reach: int) -> DataFrame:
    """Tiles of the distance to the nearest cell that is set (not 0, not NaN), infinite beyond reach; what lies outside the raster isn't set."""

    def kernel(x: np.ndarray, own: np.ndarray, _: dict) -> tuple:
        return (tiles.stored(nearest_set(x != 0, reach)),)

    return tiles.neighbourhoods(masks, reach, kernel, "v binary", "zero", 0.0)


def squared_steps(field: DataFrame) -> DataFrame:
    """Tiles with g: the squares of central differences along both axes added, one-sided at the raster's border."""

    def kernel(x: np.ndarray, own: np.ndarray, t: dict) -> tuple:
        mine = next(p for p in t["pieces"] if p["own"])
        r, c = x[2:, 1:-1] - x[:-2, 1:-1], x[1:-1, 2:] - x[1:-1, :-2]
        half_r, half_c = np.full(own.shape[0], 2.0), np.full(own.shape[1], 2.0)
        for edge, half, there in (
            (0, half_r, any(p["r"] < mine["r"] for p in t["pieces"])),
            (-1, half_r, any(p["r"] > mine["r"] and p["r"] >= mine["r"] + mine["h"] for p in t["pieces"])),
            (0, half_c, any(p["c"] < mine["c"] for p in t["pieces"])),
            (-1, half_c, any(p["c"] >= mine["c"] + mine["w"] for p in t["pieces"])),
        ):
            if not there:
                half[edge] -= 1  # nothing changes over a line of one cell
        r, c = r / np.maximum(half_r, 1)[:, None], c / np.maximum(half_c, 1)
        return tiles.stored(own), tiles.stored(c * c + r * r)

    return tiles.neighbourhoods(field, 1, kernel, "v binary, g binary")


def regions_of(cells: DataFrame) -> DataFrame:
    """cells with region, the number of its region's least cell.

    cells: scene_id, row, col, local (the number of the least cell of its part within its tile), right and
    below (whether the cell is its tile's last one in that direction); joined by sides.
    """
    rest = [c for c in cells.columns if c not in ("right", "below")]
    here = lambda dr, dc: cells.filter("below" if dr else "right").select("scene_id", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("local").alias("src"))
    met = here(1, 0).unionByName(here(0, 1)).join(cells.select("scene_id", "row", "col", F.col("local").alias("dst")), ["scene_id", "row", "col"])
    joined = graph.components(kept(met.select("src", "dst").distinct())).withColumnRenamed("node", "local")
    return cells.select(*rest).join(joined, "local", "left").select(*[c for c in rest if c != "local"], F.coalesce("component", "local").alias("region"))


def _tile(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*_PLACE, *[F.col(c).alias(n) for c, n in columns.items()])


def _gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b.to_pylist():
            gx, gy, valid = (tiles.values(t[k], t["h"], t["w"]) for k in ("gx", "gy", "valid"))
            rows.append((*[t[k] for k in ("scene_id", "band", "tr", "tc", "r0", "c0", "h", "w")], tiles.stored(np.where(np.nan_to_num(valid) != 0, np.sqrt(gx + gy), np.nan)), t["dx"], t["dy"]))
        yield tiles._batch(rows, [*tiles.KEY, *tiles.BOX, "v", "dx", "dy"], [*tiles._INTS, *[pa.binary()] * 3])


_CELLS = "scene_id int, row int, col int, dx double, dy double, g double, to_nodata double, to_hull double, to_edge int, local long, right boolean, below boolean"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _CELLS.split(", ")]
    for b in batches:
        for t in b.to_pylist():
            g, dx, dy, nodata, hull = (tiles.values(t[k], t["h"], t["w"]) for k in ("v", "dx", "dy", "nodata", "hull"))
            row, col, root = labels(np.nan_to_num(g, nan=-np.inf) >= t["limit"])
            r, c = row + t["r0"], col + t["c0"]
            edge = np.minimum(np.minimum(r, c), np.minimum(t["n_rows"] - 1 - r, t["n_cols"] - 1 - c))
            far = [pa.array(x[row, col], mask=np.isinf(x[row, col])) for x in (nodata, hull)]
            cols = [pa.array(np.full(r.size, t["scene_id"], np.int32)), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), *[pa.array(x[row, col]) for x in (dx, dy, g)], *far]
            cols += [pa.array(edge.astype(np.int32)), pa.array(cell_id(t["scene_id"], r[root], c[root])), pa.array(col == t["w"] - 1), pa.array(row == t["h"] - 1)]
            yield pa.RecordBatch.from_arrays(cols, names)


def displacement_spikes(dx: DataFrame, dy: DataFrame, valid: DataFrame, hull: DataFrame, nodata: DataFrame, factor: float = 6.0, quantile: float = 0.99, floor: float = 0.05, band: int = 8, near_nodata: int = 8, near_hull: int = 16, near_edge: int = 8) -> DataFrame:
    """scene_id, row, col, dx, dy, g, to_nodata, to_hull, to_edge, kind, region: the valid cells where a displacement field is steep.

    All inputs are tiles of one size, one band a scene: the field, and masks of valid cells, of the inside
    of the controls' hull and of the nodata border.  Steep: the gradient is at least the greatest of the
    median plus factor MADs, the quantile (both over the scene's valid cells, exact) and floor.  kind, the
    first that holds: nodata (within near_nodata of that border), hull (within near_hull of the band of
    cells inside the hull, `band` wide), edge (within near_edge of the raster's first or last line),
    internal.  Distances are null beyond what their kind asks.  region: the least cell (cell_id) of the
    steep cells joined by sides.  A scene without a valid cell gives no row.
    """
    gx, gy = _tile(squared_steps(dx), v="dx", g="gx"), _tile(squared_steps(dy), v="dy", g="gy")
    whole = dx.select(*tiles.KEY, *tiles.BOX).join(gx, [*_PLACE]).join(gy, [*_PLACE]).join(_tile(valid, v="valid"), [*_PLACE])
    steep = kept(whole.mapInArrow(_gradients, f"{tiles.TILE}, dx binary, dy binary"))
    cells = tiles.pixels(steep).filter("v IS NOT NULL").select("scene_id", "v")
    centre = kept(spread_percentiles(cells, "v", ["scene_id"], 0.5, quantile).select("scene_id", F.get("q", F.lit(0)).alias("med"), F.get("q", F.lit(1)).alias("high")))
    off = cells.join(small(centre), "scene_id").select("scene_id", F.abs(F.col("v") - F.col("med")).alias("off"))
    limits = centre.join(spread_percentiles(off, "off", ["scene_id"], 0.5), "scene_id").select("scene_id", F.greatest(F.col("med") + factor * F.get("q", F.lit(0)), "high", F.lit(floor)).alias("limit"))
    size = dx.groupBy("scene_id").agg(F.max(F.col("r0") + F.col("h")).alias("n_rows"), F.max(F.col("c0") + F.col("w")).alias("n_cols"))

    outside = tiles.mapped(hull, lambda t: 1.0 - (np.nan_to_num(tiles.values(t["v"], t["h"], t["w"])) != 0))
    depth = _tile(distances(outside, band), v="depth")
    rim = tiles.mapped(hull.join(depth, [*_PLACE]), lambda t: ((np.nan_to_num(tiles.values(t["v"], t["h"], t["w"])) != 0) & np.isfinite(tiles.values(t["depth"], t["h"], t["w"]))).astype(float), "depth")
    far = _tile(distances(nodata, near_nodata), v="nodata").join(_tile(distances(rim, near_hull), v="hull"), [*_PLACE])
    ready = steep.join(far, [*_PLACE]).join(small(limits.join(size, "scene_id")), "scene_id")
    found = regions_of(kept(ready.select("scene_id", *tiles.BOX, "v", "dx", "dy", "nodata", "hull", "limit", "n_rows", "n_cols").mapInArrow(_marked, _CELLS)))
    kind = F.when(F.col("to_nodata").isNotNull(), "nodata").when(F.col("to_hull").isNotNull(), "hull").when(F.col("to_edge") <= near_edge, "edge").otherwise("internal")
    return found.withColumn("kind", kind)


def spike_regions(spikes: DataFrame) -> DataFrame:
    """scene_id, region: size, box, middle, gradients and least distances of each region, and how many of its cells are of each kind."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("nodata", "hull", "edge", "internal")]
    box = [f("row" if "r" in n else "col").alias(n) for n, f in (("r0", F.min), ("c0", F.min), ("r1", F.max), ("c1", F.max))]
    least = [F.min(c).alias(c) for c in ("to_nodata", "to_hull", "to_edge")]
    return spikes.groupBy("scene_id", "region").agg(F.count(F.lit(1)).alias("n"), *box, F.avg("row").alias("mid_row"), F.avg("col").alias("mid_col"), F.max("g").alias("max_g"), F.avg("g").alias("mean_g"), *least, *kinds)


def spike_warnings(spikes: DataFrame) -> DataFrame:
    """scene_id: cells of each kind, regions, the steepest cell (the first of equals) and whether anything is to be warned of: all but mere edge cells."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("nodata", "hull", "edge", "internal")]
    top = F.max_by(F.struct("row", "col", "dx", "dy", "g", "kind"), F.struct("g", -F.col("row"), -F.col("col"))).alias("steepest")
    return spikes.groupBy("scene_id").agg(F.count_distinct("region").alias("regions"), *kinds, top).withColumn("warn", F.expr("nodata + hull + internal > 0"))
