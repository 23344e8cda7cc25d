"""The block grid of the local stage: cells over the union of all scenes, with each scene's moments in each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.pixels import small
from .overlap import combined_bounds


def cell_grid(scenes: DataFrame, block: int) -> DataFrame:
    """One row: left, top, cell (block pixels of scene 0), gm_n, gn_n (cells down and across)."""
    first = scenes.orderBy("scene_id").limit(1).select(F.abs("a").alias("res"))
    box = combined_bounds(scenes).join(F.broadcast(first))  # both are one row
    cell = F.col("res") * block
    return box.select(F.col("l").alias("left"), F.col("t").alias("top"), cell.alias("cell"), F.ceil((F.col("t") - F.col("bt")) / cell).cast("int").alias("gm_n"), F.ceil((F.col("r") - F.col("l")) / cell).cast("int").alias("gn_n"))


def placed(pixels: DataFrame, scenes: DataFrame, grid: DataFrame) -> DataFrame:
    """pixels with gm, gn, the cell of each pixel's corner, and fm, fn, its place in cell units."""
    both = pixels.join(small(scenes.select("scene_id", *geo.AFFINE)), "scene_id").join(F.broadcast(grid))
    x, y = geo.apply("", F.col("row"), F.col("col"))
    out = both.withColumns({"fm": (F.col("top") - y) / F.col("cell"), "fn": (x - F.col("left")) / F.col("cell")})
    cell = lambda f, n: F.least(F.floor(f).cast("int"), F.col(n) - 1)
    return out.withColumns({"gm": cell("fm", "gm_n"), "gn": cell("fn", "gn_n")}).select(*pixels.columns, "fm", "fn", "gm", "gn")


def block_table(placed_pixels: DataFrame, n_bands: int) -> DataFrame:
    """scene_id, gm, gn, band, mu, sigma, n, block_id, cx, cy: blocks with a valid pixel in every band, numbered by cell, then scene."""
    cells = placed_pixels.groupBy("scene_id", "gm", "gn", "band").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"), F.count("v").alias("n"))
    whole = cells.groupBy("scene_id", "gm", "gn").agg(F.count_if(F.col("n") > 0).alias("held")).filter(F.col("held") == n_bands).select("scene_id", "gm", "gn")
    # Numbers in two levels: a cell row's blocks, and a prefix sum over cell rows.
    from pyspark.sql import Window as W

    lines = whole.groupBy("gm").agg(F.count(F.lit(1)).alias("c"))
    start = lines.select("gm", F.coalesce(F.sum("c").over(W.orderBy("gm").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a line of cells
    ids = whole.join(F.broadcast(start), "gm").withColumn("block_id", (F.col("start") + F.row_number().over(W.partitionBy("gm").orderBy("gn", "scene_id")) - 1).cast("long")).drop("start")
    return cells.join(ids, ["scene_id", "gm", "gn"]).withColumns({"cx": F.col("gn") + 0.5, "cy": F.col("gm") + 0.5})


def block_pairs(blocks: DataFrame) -> DataFrame:
    """block_i, block_j, gm, gn: blocks of different scenes in one cell."""
    one = blocks.select("gm", "gn", "scene_id", "block_id").distinct()
    i, j = one.withColumnsRenamed({"scene_id": "si", "block_id": "block_i"}), one.withColumnsRenamed({"scene_id": "sj", "block_id": "block_j"})
    return i.join(j, ["gm", "gn"]).filter("si < sj").select("block_i", "block_j", "gm", "gn")


def idw(pixels: DataFrame, blocks: DataFrame, coef: DataFrame) -> DataFrame:
    """placed pixels with a, b: coefficients weighed by the inverse distance to the scene's blocks in the 3 x 3 cells around the nearest one.

    A block nearer than 1e-10 decides alone; a pixel without a block around it takes the nearest block
    of its scene.  The 3 x 3 part is an equi join on cells.  Cells without any block near search axis by
    axis: first the nearest block of each column of cells for each of their rows, then the nearest of
    these, so a scene of n cells makes n times its side of rows, never n times n.
    """
    # Cell centres lie at whole numbers: a pixel's own coordinates are half a cell less.
    at = pixels.withColumns({"um": F.col("fm") - 0.5, "un": F.col("fn") - 0.5})
    at = at.withColumns({"cm": F.rint("um").cast("int"), "cn": F.rint("un").cast("int")})
    own = blocks.select("scene_id", "block_id", "gm", "gn").distinct().join(coef.select("band", "block_id", "a", "b"), "block_id")
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = own.select("scene_id", "band", "gm", "gn", "a", "b", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    around = around.select("scene_id", "band", (F.col("gm") + F.col("i")).alias("cm"), (F.col("gn") + F.col("j")).alias("cn"), F.col("gm").alias("bm"), F.col("gn").alias("bn"), "a", "b")
    # Gathered by cell: at most nine blocks each.
    cells = around.groupBy("scene_id", "band", "cm", "cn").agg(F.array_sort(F.collect_list(F.struct("bm", "bn", "a", "b"))).alias("near"))
    met = at.join(cells, ["scene_id", "band", "cm", "cn"], "left")
    dist = lambda e: F.hypot(F.col("um") - e["bm"], F.col("un") - e["bn"])
    exact = F.get(F.filter("near", lambda e: dist(e) < 1e-10), F.lit(0))
    weights = F.transform("near", lambda e: 1 / F.greatest(dist(e), F.lit(1e-10)))
    weighed = lambda k: F.aggregate(F.zip_with("near", weights, lambda e, w: e[k] * w), F.lit(0.0), lambda s, x: s + x) / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    done = met.withColumns({k: F.coalesce(exact[k], weighed(k)) for k in "ab"})
    lone = at.select("scene_id", "band", "cm", "cn").distinct().join(cells, ["scene_id", "band", "cm", "cn"], "left_anti")
    own, lines = own.select("scene_id", "band", "gm", "gn", "a", "b"), lone.select("scene_id", "band", "cm").distinct()
    column = lines.join(own, ["scene_id", "band"]).groupBy("scene_id", "band", "cm", "gn").agg(F.min_by(F.struct("gm", "a", "b"), F.struct(F.abs(F.col("gm") - F.col("cm")), F.col("gm"))).alias("s"))
    met_lone = lone.join(column.select("scene_id", "band", "cm", "gn", "s.gm", "s.a", "s.b"), ["scene_id", "band", "cm"])
    far = met_lone.groupBy("scene_id", "band", "cm", "cn").agg(F.min_by(F.struct("a", "b"), F.struct(F.hypot(F.col("gm") - F.col("cm"), F.col("gn") - F.col("cn")), F.col("gm"), F.col("gn"))).alias("f"))
    out = done.join(far, ["scene_id", "band", "cm", "cn"], "left")
    return out.select(*pixels.columns, F.coalesce("a", "f.a").alias("a"), F.coalesce("b", "f.b").alias("b"))
