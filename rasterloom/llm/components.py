"""Connected components of an edge table, by alternating large-star and small-star contraction.

Every round is a few joins and map-side-combined minima over edges; nothing is gathered on the
driver but one count and one checksum a round, and each round's edges are written to the shared
folder.  A hub's edges are never collected into one row.

A round costs the driver some nine jobs, each with buffers of megabytes however few its rows are.
So up to LOCAL edges are contracted in one task, which holds their two columns; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, light, stored

LOCAL = 1 << 19


def _edges(df: DataFrame) -> DataFrame:
    """Distinct (a, b) with a > b."""
    return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node point to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    return _edges(both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
    joined = edges.join(least, F.col("a") == F.col("node"))
    return _edges(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))))


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of edges between a and b: roots hook to their least neighbouring root, then all paths are shortened."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, (a, b) = np.arange(len(nodes)), place.reshape(2, -1)
    while len(a):
        a, b = up[a], up[b]
        on = a != b
        a, b = a[on], b[on]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


@light
def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b), in one task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_roots(*map(np.concatenate, zip(*held)))], ["node", "root"])


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node that has an edge: root is the least node of its component.  Nodes are longs."""
    spark = edges.sparkSession
    now = stored(_edges(edges.select(F.col(left).alias("a"), F.col(right).alias("b"))), "edges")
    if now.count() <= LOCAL:
        return stored(now.coalesce(1).mapInArrow(_rooted, "node long, root long"), "roots")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark, old = tuple(seen), now.inputFiles()
        now = stored(_small_star(_large_star(now)), "edges")
        if old:
            forget(spark, old[0].rsplit("/", 1)[0])
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
