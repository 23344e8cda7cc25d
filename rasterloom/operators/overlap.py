"""Which scenes overlap, where, and the pixels of an overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.pixels import small


def with_bounds(scenes: DataFrame) -> DataFrame:
    """scenes (scene_id, n_rows, n_cols, affine) with l, bt, r, t."""
    return scenes.withColumns(geo.bounds("", F.col("n_rows"), F.col("n_cols")))


def combined_bounds(scenes: DataFrame) -> DataFrame:
    """The box around all scenes."""
    return with_bounds(scenes).agg(F.min("l").alias("l"), F.min("bt").alias("bt"), F.max("r").alias("r"), F.max("t").alias("t"))


def detect(scenes: DataFrame, min_pixels: int = 100, cell: float = 1000.0) -> DataFrame:
    """Pairs i < j that overlap in at least min_pixels pixels of i: i, j, the windows i_r0 .. j_c1, px.

    A range join as an equi join: scenes are listed under every cell x cell square that they touch,
    meet in equal squares, and each pair counts in the square that holds the lower left corner of its
    intersection, so no pair comes twice.
    """
    boxes = with_bounds(scenes)
    low = lambda c: F.floor(F.col(c) / cell).cast("int")
    listed = boxes.select("*", F.explode(F.sequence(low("l"), low("r"))).alias("gx")).select("*", F.explode(F.sequence(low("bt"), low("t"))).alias("gy"))
    i, j = (listed.select("gx", "gy", *[F.col(c).alias(f"{p}_{c}") for c in boxes.columns]) for p in "ij")
    box = geo.intersection("i_", "j_")
    met = i.join(j, ["gx", "gy"]).filter((F.col("i_scene_id") < F.col("j_scene_id")) & geo.overlaps("i_", "j_"))
    met = met.filter((F.floor(box["l"] / cell) == F.col("gx")) & (F.floor(box["bt"] / cell) == F.col("gy")))
    windows = {f"{p}_{k}": w for p in "ij" for k, w in geo.window_of(f"{p}_", box).items()}
    # All windows in one generator: merged into the join and cut down to some columns, their shared terms came out as 0 in generated code.
    out = met.select(F.col("i_scene_id").alias("i"), F.col("j_scene_id").alias("j"), F.inline(F.array(F.struct(*[w.alias(k) for k, w in windows.items()]))))
    return out.withColumn("px", ((F.col("i_r1") - F.col("i_r0")) * (F.col("i_c1") - F.col("i_c0"))).cast("long")).filter(F.col("px") >= min_pixels)


def sides(pixels: DataFrame, overlaps: DataFrame) -> DataFrame:
    """i, j, side ("i" or "j"), band, row, col, v: both scenes' pixels of each overlap, either side by itself."""

    def side(p: str) -> DataFrame:
        return overlaps.select("i", "j", F.lit(p).alias("side"), F.col(p).alias("scene_id"), *[F.col(f"{p}_{k}").alias(k) for k in ("r0", "r1", "c0", "c1")])

    both = small(side("i").unionByName(side("j")))
    met = pixels.join(both, "scene_id").filter("row >= r0 AND row < r1 AND col >= c0 AND col < c1")
    return met.select("i", "j", "side", "band", "row", "col", "v")


def joint(pixels: DataFrame, overlaps: DataFrame) -> DataFrame:
    """i, j, band, r, c (within the overlap), vi, vj: pixels aligned by their place in the windows."""

    def side(p: str) -> DataFrame:
        rows = overlaps.select("i", "j", F.col(p).alias("scene_id"), *[F.col(f"{p}_{k}").alias(k) for k in ("r0", "r1", "c0", "c1")])
        met = pixels.join(small(rows), "scene_id").filter("row >= r0 AND row < r1 AND col >= c0 AND col < c1")
        return met.select("i", "j", "band", (F.col("row") - F.col("r0")).alias("r"), (F.col("col") - F.col("c0")).alias("c"), F.col("v").alias(f"v{p}"))

    return side("i").join(side("j"), ["i", "j", "band", "r", "c"])


def centres(scenes: DataFrame, overlaps: DataFrame, edges: DataFrame) -> DataFrame:
    """scene_id, cx, cy: the mean centre of the overlaps on a scene's tree edges (parent, child); crops stand on these."""
    boxes = with_bounds(scenes).select("scene_id", "l", "bt", "r", "t")
    i, j = (boxes.select(*[F.col(c).alias(f"{p}_{c}") for c in boxes.columns]) for p in "ij")
    pair = overlaps.select("i", "j").join(small(i), F.col("i") == F.col("i_scene_id")).join(small(j), F.col("j") == F.col("j_scene_id"))
    box = geo.intersection("i_", "j_")
    mid = pair.select("i", "j", ((box["l"] + box["r"]) / 2).alias("x"), ((box["bt"] + box["t"]) / 2).alias("y"))
    tree = edges.select(F.least("parent", "child").alias("i"), F.greatest("parent", "child").alias("j"))
    return mid.join(tree, ["i", "j"]).select(F.explode(F.array("i", "j")).alias("scene_id"), "x", "y").groupBy("scene_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def crop_windows(scenes: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """scenes with r0, c0: the corner of a size x size window around each scene's point, moved to lie inside."""
    row, col = geo.inverse("", F.col("cx"), F.col("cy"))
    start = lambda at, n: F.greatest(F.lit(0), F.least(F.floor(at).cast("int") - size // 2, n - size))
    placed = scenes.join(points, "scene_id").withColumns({"r0": start(row, F.col("n_rows")), "c0": start(col, F.col("n_cols"))})
    return placed.drop(*[c for c in points.columns if c != "scene_id"])


def crop(pixels: DataFrame, scenes: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """Pixels of each scene's window, with the new row and col."""
    boxes = crop_windows(scenes, points, size).select("scene_id", "r0", "c0")
    met = pixels.join(small(boxes), "scene_id").filter(f"row >= r0 AND row < r0 + {size} AND col >= c0 AND col < c0 + {size}")
    return met.select("scene_id", "band", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "v")


def cropped_scenes(scenes: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """The scene table of the crops: moved corners, and at most size rows and columns."""
    x, y = geo.apply("", F.col("r0"), F.col("c0"))
    least = {n: F.least(F.lit(size), F.col(n) - F.col(s)) for n, s in (("n_rows", "r0"), ("n_cols", "c0"))}
    return crop_windows(scenes, points, size).withColumns({"c": x, "f": y, **least}).select(*scenes.columns)


def middles(scenes: DataFrame) -> DataFrame:
    """scene_id, cx, cy: the middle of each scene."""
    return with_bounds(scenes).select("scene_id", ((F.col("l") + F.col("r")) / 2).alias("cx"), ((F.col("bt") + F.col("t")) / 2).alias("cy"))


def nearest_scenes(scenes: DataFrame, n: int) -> DataFrame:
    """The n scenes nearest to the centre of all, from their headers alone."""
    boxes = with_bounds(scenes).withColumns({"x": (F.col("l") + F.col("r")) / 2, "y": (F.col("bt") + F.col("t")) / 2})
    mid = boxes.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    far = boxes.join(F.broadcast(mid)).withColumn("distance", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))  # mid is one row
    return far.orderBy("distance", "scene_id").limit(n).select("scene_id", "distance")
