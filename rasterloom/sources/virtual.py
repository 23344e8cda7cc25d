"""Rasters made from the star-schema tables, so that plans and SQL can be compared on equal pixels.

grid: five one-band scenes from events, 30 x 24, neighbours 6 columns apart; empty cells are null.
broad: one scene of 64 x 64 tiles, a tile a supplier and half of a shipping month, a coarse value from lineitem under a fine pattern.
wide: four scenes of four bands from lineitem, windows over the part keys.
spectra: 64-band spectra from embeddings, before and after a gain and an offset by label.
links: a graph of key relations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiles

ROWS, COLS, STEP, SCENES = 30, 24, 6, 4
BROAD, BROAD_COLS = 64, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, band (0), row, col, gcol, v: dense, null where no event fell."""
    events = table(spark, sf_dir, "events")
    kinds = events.agg(F.array_sort(F.collect_set("event_type")).alias("k")).select(F.posexplode("k").alias("scene_id", "event_type"))
    cells = events.groupBy("event_type", (F.dayofmonth("ts") - 1).alias("row"), F.hour("ts").alias("col")).agg(F.avg("value").alias("v"))
    dense = kinds.select("scene_id", "event_type", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(COLS - 1))).alias("col"))
    full = dense.join(cells, ["event_type", "row", "col"], "left")
    return full.select("scene_id", F.lit(0).alias("band"), "row", "col", (F.col("col") + STEP * F.col("scene_id")).alias("gcol"), "v")


def grid_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, size and affine of the grid's scenes: one unit a pixel, north up, tops at y = ROWS."""
    kinds = table(spark, sf_dir, "events").agg(F.count_distinct("event_type").alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("scene_id"))
    one, zero = F.lit(1.0), F.lit(0.0)
    return kinds.select("scene_id", F.lit(ROWS).alias("n_rows"), F.lit(COLS).alias("n_cols"), one.alias("a"), zero.alias("b"), (F.col("scene_id") * float(STEP)).alias("c"), zero.alias("d"), (-one).alias("e"), F.lit(float(ROWS)).alias("f"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, row (part key), col (line number), s (four bands): averages of what falls in a cell."""
    lines = table(spark, sf_dir, "lineitem")
    span = lines.agg((F.max("l_partkey") + 1).alias("p"))
    scenes = F.filter(F.sequence(F.lit(0), F.lit(SCENES - 1)), lambda k: (F.col("l_partkey") >= 0.2 * k * F.col("p")) & (F.col("l_partkey") < 0.2 * k * F.col("p") + 0.4 * F.col("p")))
    bands = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = lines.join(F.broadcast(span)).select("l_partkey", "l_linenumber", *bands, F.explode(scenes).alias("scene_id"))  # span is one row
    return rows.groupBy("scene_id", F.col("l_partkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.array(*[F.avg(b) for b in bands]).alias("s"))


def wide_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a row a band: scene_id, band, row, col, v."""
    return wide(spark, sf_dir).select("scene_id", "row", "col", F.posexplode("s").alias("band", "v"))


def _broad_values(t: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q + (7 r + 3 c) % 11, NaN where (5 r + c) % 97 is 0; in small integers, by rows and columns."""
    fine = (7 * r % 11).astype(np.uint8) + (3 * c % 11).astype(np.uint8)
    hole = (5 * r % 97).astype(np.uint8) + (c % 97).astype(np.uint8)
    x = t["q"].astype(float)[:, None, None] + np.where(fine < 11, fine, fine - np.uint8(11))
    x[(hole == 0) | (hole == 97)] = np.nan
    return x


def broad(spark: SparkSession, sf_dir: str) -> tiles.Made:
    """A made raster (operators/tiles.py) of one scene: suppliers down, months and odd and even line numbers across; a tile without lines is invalid."""
    lines = table(spark, sf_dir, "lineitem")
    across = ((F.month("l_shipdate") - 1) * 2 + F.col("l_linenumber") % 2).cast("int")
    cells = lines.groupBy((F.col("l_suppkey") - 1).cast("int").alias("tr"), across.alias("tc")).agg(F.avg("l_quantity").alias("q"))
    n = tiles.tasks(spark)
    down = lines.agg(F.max("l_suppkey").cast("int").alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tr")).repartition(n, "tr")
    dense = down.select("tr", F.explode(F.sequence(F.lit(0), F.lit(BROAD_COLS - 1))).alias("tc")).join(cells, ["tr", "tc"], "left")
    dense = dense.repartition(n, "tr", "tc")  # few bytes each, but 32 KB once they are tiles
    return tiles.Made(dense.select(F.lit(0).alias("scene_id"), F.lit(0).alias("band"), "tr", "tc", "q"), ("q",), _broad_values, BROAD)


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel_id, label, o (before), n (after)."""
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pixel_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("o"))
    return x.withColumn("n", F.transform("o", lambda v: v * (1 + 0.01 * F.col("label")) + 0.001 * F.col("label")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: nations sharing a region, and nations joined by customers who buy from their suppliers' region."""
    nation = table(spark, sf_dir, "nation")
    left, right = nation.select("n_regionkey", F.col("n_nationkey").alias("src")), nation.select("n_regionkey", F.col("n_nationkey").alias("dst"))
    return left.join(right, "n_regionkey").filter("src < dst").select("src", "dst")


#: The same rasters as SQL, to stand before a query.
GRID_SQL = """
kinds AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS scene_id FROM (SELECT DISTINCT event_type FROM events)),
cells AS (SELECT event_type, CAST(day(ts) - 1 AS INT) AS row, CAST(hour(ts) AS INT) AS col, avg(value) AS v FROM events GROUP BY ALL),
grid AS (
  SELECT scene_id, 0 AS band, CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col, CAST(c.i + 6 * scene_id AS INT) AS gcol, v
  FROM kinds CROSS JOIN range(30) AS r(i) CROSS JOIN range(24) AS c(i)
  LEFT JOIN cells ON cells.event_type = kinds.event_type AND cells.row = r.i AND cells.col = c.i),
pairs AS (
  SELECT a.scene_id AS i, b.scene_id AS j, 6 * b.scene_id AS lo, 6 * a.scene_id + 24 AS hi
  FROM kinds a JOIN kinds b ON a.scene_id < b.scene_id AND 6 * b.scene_id < 6 * a.scene_id + 24),
sides AS (
  SELECT i, j, 'i' AS side, g.* FROM pairs JOIN grid g ON g.scene_id = i AND gcol >= lo AND gcol < hi
  UNION ALL SELECT i, j, 'j' AS side, g.* FROM pairs JOIN grid g ON g.scene_id = j AND gcol >= lo AND gcol < hi)
"""

BROAD_SQL = """
bq AS (SELECT CAST(l_suppkey - 1 AS INT) AS tr, CAST((month(l_shipdate) - 1) * 2 + l_linenumber % 2 AS INT) AS tc, avg(l_quantity) AS q FROM lineitem GROUP BY ALL),
broad AS (
  SELECT s.i * 64 + r.i AS row, k.i * 64 + c.i AS col, CASE WHEN (5 * (s.i * 64 + r.i) + k.i * 64 + c.i) % 97 <> 0 THEN q + (7 * (s.i * 64 + r.i) + 3 * (k.i * 64 + c.i)) % 11 END AS v
  FROM range((SELECT max(l_suppkey) FROM lineitem)) s(i) CROSS JOIN range(24) k(i) CROSS JOIN range(64) r(i) CROSS JOIN range(64) c(i) LEFT JOIN bq ON bq.tr = s.i AND bq.tc = k.i)"""

WIDE_SQL = """
span AS (SELECT max(l_partkey) + 1 AS p FROM lineitem),
wide AS (
  SELECT CAST(k.i AS INT) AS scene_id, l_partkey AS row, l_linenumber AS col, avg(l_quantity) AS b0, avg(l_extendedprice) AS b1, avg(l_discount) AS b2, avg(l_tax) AS b3
  FROM lineitem CROSS JOIN span JOIN range(4) AS k(i) ON l_partkey >= CAST(0.2 AS DOUBLE) * k.i * p AND l_partkey < CAST(0.2 AS DOUBLE) * k.i * p + CAST(0.4 AS DOUBLE) * p GROUP BY ALL),
wpix AS (
  SELECT scene_id, row, col, 0 AS band, b0 AS v FROM wide UNION ALL SELECT scene_id, row, col, 1, b1 FROM wide
  UNION ALL SELECT scene_id, row, col, 2, b2 FROM wide UNION ALL SELECT scene_id, row, col, 3, b3 FROM wide)
"""

SPECTRA_SQL = """
px AS (SELECT vec_id AS pixel_id, label, unnest(range(1, 65)) AS k, unnest(embedding)::DOUBLE AS o FROM embeddings),
sp AS (SELECT pixel_id, label, k, o, o * (1 + CAST(0.01 AS DOUBLE) * label) + CAST(0.001 AS DOUBLE) * label AS n FROM px)
"""
