"""Stretches for display, and a PNG writer for small previews."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import small, spread_percentiles
from . import overviews, tiles


def joint_stretch(pixels: DataFrame, bands: list[int], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """band, vmin, vmax: percentiles over all scenes."""
    q = spread_percentiles(pixels.filter(F.col("band").isin(bands)), "v", ["band"], low, high)
    return q.select("band", F.get("q", F.lit(0)).alias("vmin"), F.get("q", F.lit(1)).alias("vmax"))


def stretched(pixels: DataFrame, stretch: DataFrame) -> DataFrame:
    """pixels with dn: 0 to 255, rounded half to even, 0 where invalid; a flat range gives 0."""
    both = pixels.join(F.broadcast(stretch), "band")  # a row a band
    x = (F.col("v") - F.col("vmin")) / F.nullif(F.col("vmax") - F.col("vmin"), F.lit(0.0)) * 255
    return both.withColumn("dn", F.coalesce(F.rint(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x))).cast("int"), F.lit(0))).drop("vmin", "vmax")


def preview(pixels: DataFrame, bands: list[int], step: int) -> np.ndarray:
    """rows x cols x 3 bytes of every step-th pixel of one scene: the size of a preview, chosen by step."""
    rows = stretched(pixels, joint_stretch(pixels, bands)).filter(f"row % {step} = 0 AND col % {step} = 0").select("band", (F.col("row") / step).cast("int").alias("r"), (F.col("col") / step).cast("int").alias("c"), "dn").toPandas()
    out = np.zeros((int(rows["r"].max()) + 1, int(rows["c"].max()) + 1, 3), np.uint8)
    for k, b in enumerate(bands):
        g = rows[rows["band"] == b]
        out[g["r"], g["c"], k] = g["dn"]
    return out


def quicklook(scene: DataFrame, bands: list[int], rows: int, cols: int, most: int = 1024, size: int = tiles.SIZE) -> np.ndarray:
    """rows x cols x 3 bytes, at most `most` on a side, of one scene's tiles: stretched and drawn from one level of its pyramid."""
    k = overviews.level_for(rows, cols, most)
    wanted = scene.filter(F.col("band").isin(bands))
    level = overviews.pyramid(wanted, k, size)[-1] if k else wanted
    return preview(tiles.pixels(level), bands, 1)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image as PNG."""
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


# -- the tables behind comparison figures, and their panels


def side_by_side(panels: list[np.ndarray], gap: int = 4) -> np.ndarray:
    """Panels (rows x cols x 3) beside each other on white, tops aligned."""
    h = max(p.shape[0] for p in panels)
    out = np.full((h, sum(p.shape[1] for p in panels) + gap * (len(panels) - 1), 3), 255, np.uint8)
    at = 0
    for p in panels:
        out[: p.shape[0], at : at + p.shape[1]] = p
        at += p.shape[1] + gap
    return out


def comparison_crop(methods: dict[str, DataFrame], bands: list[int], scene_id: int, row: int, col: int, size: int = 256) -> np.ndarray:
    """The same window of one scene under each method, under one stretch: what the first method's window spans."""
    window = lambda px: px.filter((F.col("scene_id") == scene_id) & F.col("row").between(row, row + size - 1) & F.col("col").between(col, col + size - 1))
    crops = [window(px) for px in methods.values()]
    return side_by_side([_panel(c, joint_stretch(crops[0], bands), bands, row, col, size) for c in crops])


def seam_crop(mosaic: DataFrame, seam: DataFrame, bands: list[int], size: int = 256, colour: tuple[int, int, int] = (255, 0, 0)) -> np.ndarray:
    """The window of a mosaic (band, gr, gc, v) around the middle of a seam (row, sc), with the seam drawn in."""
    mid = seam.agg(F.percentile("row", F.lit(0.5)).alias("r"), F.percentile("sc", F.lit(0.5)).alias("c")).first()
    row, col = max(0, int(mid["r"]) - size // 2), max(0, int(mid["c"]) - size // 2)
    px = mosaic.filter(F.col("gr").between(row, row + size - 1) & F.col("gc").between(col, col + size - 1)).select(F.lit(0).alias("scene_id"), "band", F.col("gr").alias("row"), F.col("gc").alias("col"), "v")
    out = _panel(px, joint_stretch(px, bands), bands, row, col, size)
    on = seam.filter(F.col("row").between(row, row + size - 1) & F.col("sc").between(col, col + size - 1)).select("row", "sc").toPandas()  # a point a row of the window
    out[on["row"] - row, on["sc"] - col] = colour
    return out


def _panel(px: DataFrame, stretch: DataFrame, bands: list[int], row: int, col: int, size: int) -> np.ndarray:
    rows = stretched(px.filter(F.col("band").isin(bands)), stretch).select("band", "row", "col", "dn").toPandas()  # at most size x size a band
    out = np.zeros((size, size, 3), np.uint8)
    for k in range(3):
        g = rows[rows["band"] == bands[min(k, len(bands) - 1)]]
        out[g["row"] - row, g["col"] - col, k] = g["dn"]
    return out


def overlap_histograms(sides: DataFrame, bins: int = 100) -> DataFrame:
    """i, j, band, side, bin, n: counts on each pair's joint range, the last bin closed."""
    key = ["i", "j", "band"]
    span = sides.groupBy(*key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranged = sides.filter("v IS NOT NULL").join(small(span), key)
    b = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)).cast("int")
    return ranged.groupBy(*key, "side", F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cutline(joint: DataFrame, row: int | None = None) -> DataFrame:
    """i, j, band, c, vi, vj: both scenes along one row of each overlap, by default the middle one."""
    if row is not None:
        return joint.filter(F.col("r") == row).select("i", "j", "band", "c", "vi", "vj")
    mid = joint.groupBy("i", "j").agg(F.floor((F.max("r") + 1) / 2).alias("mid"))
    return joint.join(small(mid), ["i", "j"]).filter("r = mid").select("i", "j", "band", "c", "vi", "vj")


def difference_map(joint: DataFrame) -> DataFrame:
    """i, j, band, r, c, d: vi - vj where both are valid."""
    return joint.filter("vi IS NOT NULL AND vj IS NOT NULL").select("i", "j", "band", "r", "c", (F.col("vi") - F.col("vj")).alias("d"))
