"""Mosaics: scenes on one grid, joined under a rule for where they overlap.

Grid pixels are (scene_id, band, gr, gc, v) on the canvas.  A pixel is usable if all its bands are.
Weights are exact Euclidean distances to the nearest unusable pixel, the canvas's outside included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.pixels import kept, small
from .overlap import combined_bounds
from .seamline import STRIP, min_cost_seam, seams  # noqa: F401

TINY = 1e-6


def canvas(scenes: DataFrame, resolution: float | None = None) -> DataFrame:
    """One row: left, top, res, n_rows, n_cols of the union box at the finest resolution."""
    res = F.lit(resolution) if resolution else F.min(F.abs("a"))
    box = combined_bounds(scenes).join(F.broadcast(scenes.agg(res.alias("res"))))  # both are one row
    count = lambda lo, hi: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / F.col("res"))).cast("int")
    return box.select(F.col("l").alias("left"), F.col("t").alias("top"), "res", count("bt", "t").alias("n_rows"), count("l", "r").alias("n_cols"))


def _bilinear(at: DataFrame, pixels: DataFrame, *key: str) -> DataFrame:
    """scene_id, band, gr, gc, v: cells (key, gr, gc) at the places fr, fc of their sources' pixels, from the valid ones of the four around."""
    at = at.withColumns({"r0": F.floor("fr").cast("int"), "c0": F.floor("fc").cast("int")})
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    four = at.select(*key, "gr", "gc", "fr", "fc", "r0", "c0", corner.alias("k"))
    w = (1 - F.abs(F.col("fr") - F.col("r0") - F.col("k.i"))) * (1 - F.abs(F.col("fc") - F.col("c0") - F.col("k.j")))
    wanted = four.select(*key, "gr", "gc", (F.col("r0") + F.col("k.i")).alias("row"), (F.col("c0") + F.col("k.j")).alias("col"), w.alias("w")).filter("w > 1e-12")
    met = wanted.join(pixels.filter("v IS NOT NULL"), [*key, "row", "col"])
    return met.groupBy("scene_id", "band", "gr", "gc").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def regridded(pixels: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """pixels of the bands in sources (scene_id, band, affine, n_rows, n_cols) on their scene's grid in targets (scene_id, affine, n_rows, n_cols).

    Bilinear; weights are shared anew among the valid neighbours, and a cell beyond the source or without any is null.
    """
    source = sources.select("scene_id", "band", *[F.col(c).alias(f"s_{c}") for c in (*geo.AFFINE, "n_rows", "n_cols")])
    lines = targets.select("scene_id", *geo.AFFINE, "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("gr")).join(small(source), "scene_id")
    cells = lines.select("*", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("gc"))
    row, col = geo.inverse("s_", *geo.apply("", F.col("gr") + 0.5, F.col("gc") + 0.5))
    at = cells.withColumns({"fr": row - 0.5, "fc": col - 0.5})
    inside = at.filter("fr > -0.5 - 1e-9 AND fr < s_n_rows - 0.5 + 1e-9 AND fc > -0.5 - 1e-9 AND fc < s_n_cols - 0.5 + 1e-9")
    found = _bilinear(inside, pixels, "scene_id", "band")
    return cells.select("scene_id", "band", "gr", "gc").join(found, ["scene_id", "band", "gr", "gc"], "left").select("scene_id", "band", F.col("gr").alias("row"), F.col("gc").alias("col"), "v")


def reproject(pixels: DataFrame, scenes: DataFrame, grid: DataFrame, bands: list[int]) -> DataFrame:
    """scene_id, band, gr, gc, v on the canvas: bilinear from the four pixels around each cell's centre.

    Each canvas cell in a scene's box looks up its four neighbours by an equi join; weights are
    shared anew among the valid ones, and a cell is usable only if all bands are.
    """
    boxes = scenes.withColumns(geo.bounds("", F.col("n_rows"), F.col("n_cols"))).withColumnsRenamed({"n_rows": "sr", "n_cols": "sc"}).join(F.broadcast(grid))
    lo = lambda a, b: F.greatest(F.lit(0), F.floor((F.col(a) - F.col(b)) / F.col("res"))).cast("int")
    hi = lambda a, b, n: F.least(F.col(n) - 1, F.ceil((F.col(a) - F.col(b)) / F.col("res")).cast("int"))
    cells = boxes.select("*", F.explode(F.sequence(lo("top", "t"), F.greatest(lo("top", "t"), hi("top", "bt", "n_rows")))).alias("gr")).select("*", F.explode(F.sequence(lo("l", "left"), F.greatest(lo("l", "left"), hi("r", "left", "n_cols")))).alias("gc"))
    x, y = F.col("left") + (F.col("gc") + 0.5) * F.col("res"), F.col("top") - (F.col("gr") + 0.5) * F.col("res")
    row, col = geo.inverse("", x, y)
    at = cells.withColumns({"fr": row - 0.5, "fc": col - 0.5}).filter("fr > -0.5 - 1e-9 AND fr < sr - 0.5 + 1e-9 AND fc > -0.5 - 1e-9 AND fc < sc - 0.5 + 1e-9")
    cells = _bilinear(at, pixels, "scene_id")
    whole = cells.groupBy("scene_id", "gr", "gc").agg(F.count("v").alias("n")).filter(F.col("n") == len(bands)).drop("n")
    return cells.join(whole, ["scene_id", "gr", "gc"])


def _column_distance(g: pd.DataFrame) -> pd.DataFrame:
    """Distance down a column to the nearest unusable row, squared."""
    rows = np.sort(g["gr"].to_numpy())
    new = np.flatnonzero(np.diff(rows, prepend=rows[0] - 2) != 1)
    run = np.searchsorted(new, np.arange(len(rows)), side="right") - 1
    first, last = rows[new][run], rows[np.append(new[1:], len(rows)) - 1][run]
    d = np.minimum(rows - first + 1, last - rows + 1).astype(float)
    return pd.DataFrame({"scene_id": g["scene_id"].iloc[0], "gr": rows, "gc": g["gc"].iloc[0], "g": d * d})


def _row_distance(g: pd.DataFrame) -> pd.DataFrame:
    """The lower envelope of the row's parabolas; unusable cells between and beyond are parabolas of height 0."""
    g = g.sort_values("gc")
    cols, high = g["gc"].to_numpy(), g["g"].to_numpy()
    lo, hi = cols[0] - 1, cols[-1] + 1
    f = np.zeros(hi - lo + 1)
    f[cols - lo] = high
    v, z, k = np.zeros(len(f), int), np.empty(len(f) + 1), 0
    z[0], z[1] = -np.inf, np.inf
    for q in range(1, len(f)):
        while True:
            s = ((f[q] + q * q) - (f[v[k]] + v[k] ** 2)) / (2 * (q - v[k]))
            if s > z[k]:
                break
            k -= 1
        k += 1
        v[k], z[k], z[k + 1] = q, s, np.inf
    at = np.searchsorted(z[1 : k + 1], cols - lo)
    return pd.DataFrame({"scene_id": g["scene_id"].iloc[0], "gr": g["gr"].iloc[0], "gc": cols, "w": np.sqrt((cols - lo - v[at]) ** 2 + f[v[at]])})


def edt(cells: DataFrame) -> DataFrame:
    """scene_id, gr, gc, w: exact distance of usable cells (distinct scene_id, gr, gc) to the nearest cell that isn't one.

    Separable: each column by itself, then each row by itself, so the groups are lines, never scenes.
    """
    down = cells.groupBy("scene_id", "gc").applyInPandas(_column_distance, "scene_id int, gr int, gc int, g double")
    return down.groupBy("scene_id", "gr").applyInPandas(_row_distance, "scene_id int, gr int, gc int, w double")


def weight_map(cells: DataFrame) -> DataFrame:
    """scene_id, gr, gc, w: the distance as a share of its scene's greatest."""
    w = edt(cells)
    return w.join(small(w.groupBy("scene_id").agg(F.max("w").alias("most"))), "scene_id").select("scene_id", "gr", "gc", (F.col("w") / F.col("most")).alias("w"))


def weighted(px: DataFrame, weights: DataFrame) -> DataFrame:
    """band, gr, gc, v: sum(w v) / sum(w), w the distance plus a little."""
    w = F.col("w") + TINY
    return px.join(weights, ["scene_id", "gr", "gc"]).groupBy("band", "gr", "gc").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def sources(weights: DataFrame) -> DataFrame:
    """gr, gc, scene_id: the scene of the greatest distance, the first of equals."""
    return weights.groupBy("gr", "gc").agg(F.max_by("scene_id", F.struct("w", (-F.col("scene_id")).alias("k"))).alias("scene_id"))


def source_selection(px: DataFrame, weights: DataFrame) -> DataFrame:
    return px.join(sources(weights), ["gr", "gc", "scene_id"]).select("band", "gr", "gc", "v")


def seam_pairs(labels: DataFrame) -> DataFrame:
    """i, j: pairs of scenes whose labels (gr, gc, scene_id) meet across a cell's side."""
    found = []
    for line, along in (("gr", "gc"), ("gc", "gr")):
        w = W.partitionBy(line).orderBy(along)
        nxt = labels.select("scene_id", F.lead("scene_id").over(w).alias("other"), (F.lead(along).over(w) - F.col(along)).alias("step"))
        found.append(nxt.filter("step = 1 AND scene_id <> other").select(F.least("scene_id", "other").alias("i"), F.greatest("scene_id", "other").alias("j")))
    return found[0].unionByName(found[1]).distinct()


def narrow_feather(px: DataFrame, weights: DataFrame, width: int, least: int = 10, strip: int = STRIP) -> DataFrame:
    """Source selection, then a linear blend across the least-cost seam of each pair of meeting scenes.

    The width is at most half the overlap's shorter side; pairs go in order, and a cell is blended by
    the first pair whose zone holds it.  Overlaps of under ten cells stay as selected.  Seams are found
    in one band, strip by strip (seamline.py).
    """
    weights = kept(weights)
    chosen = source_selection(px, weights)
    pairs = small(kept(seam_pairs(sources(weights))))
    side = lambda p, v: px.select(F.col("scene_id").alias(p), "band", "gr", "gc", F.col("v").alias(v))
    both = side("i", "va").join(pairs, "i").join(side("j", "vb"), ["j", "band", "gr", "gc"])
    lines = kept(seams(both.filter("band = 0").select("i", "j", "gr", "gc", "va", "vb"), strip).filter(f"n >= {least}"))
    on = both.join(lines, ["i", "j"]).filter("line = if(flat, gc, gr)")
    use = F.greatest(F.lit(1), F.least(F.lit(width), F.floor(F.col("short") / 2).cast("int")))
    away = F.when(F.col("flat"), F.col("gr")).otherwise(F.col("gc")) - F.col("sc")
    # Which scene lies before the seam: the one whose cells do.
    blend = on.withColumns({"d": away, "half": use}).filter("abs(d) <= half")
    wb = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("d") / (2.0 * F.col("half"))))
    first = F.row_number().over(W.partitionBy("band", "gr", "gc").orderBy("i", "j"))
    zone = blend.withColumn("k", first).filter("k = 1").select("band", "gr", "gc", ((1 - wb) * F.col("va") + wb * F.col("vb")).alias("f"))
    return chosen.join(zone, ["band", "gr", "gc"], "left").select("band", "gr", "gc", F.coalesce("f", "v").alias("v"))


def make(px: DataFrame, mode: str = "weighted", width: int = 64, strip: int = STRIP) -> DataFrame:
    """band, gr, gc, v by mode: weighted, source_selection or narrow_feather."""
    weights = edt(px.select("scene_id", "gr", "gc").distinct())
    if mode == "weighted":
        return weighted(px, weights)
    if mode == "source_selection":
        return source_selection(px, weights)
    if mode == "narrow_feather":
        return narrow_feather(px, weights, width, strip=strip)
    raise ValueError(f"unknown mosaic mode {mode!r}")


def hard_seam(a: DataFrame, b: DataFrame, seam: int) -> DataFrame:
    """band, gr, gc, v: b from column seam on, a before it, the other where one has nothing."""
    side = lambda x, v: x.select("band", "gr", "gc", F.col("v").alias(v))
    both = side(a, "va").join(side(b, "vb"), ["band", "gr", "gc"], "full")
    return both.select("band", "gr", "gc", F.when(F.col("gc") >= seam, F.coalesce("vb", "va")).otherwise(F.coalesce("va", "vb")).alias("v"))


def with_nodata(mosaic: DataFrame, n_bands: int, nodata: float | None) -> DataFrame:
    """All bands of a cell become nodata if one of them is missing; nodata None gives NaN."""
    held = mosaic.groupBy("gr", "gc").agg(F.count("v").alias("n"))
    out = mosaic.join(held, ["gr", "gc"])
    return out.withColumn("v", F.when(F.col("n") == n_bands, F.col("v")).otherwise(float("nan") if nodata is None else nodata)).drop("n")
