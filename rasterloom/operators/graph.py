"""Graphs of scenes: spanning trees, parents, components, loops, network adjustment.

Edges are a row an overlapping pair, so trees and equations are solved on the driver from a table
of that size; components and loops of any edge table are plans.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import kept
from .adjust import Sparse, conjugate_gradients


def spanning_tree(edges: list[tuple[int, int]], root: int = 0) -> list[tuple[int, int]]:
    """(parent, child) in breadth-first order; a node's neighbours in the order of the edges."""
    near: dict[int, list[int]] = {}
    for i, j in edges:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    seen, queue, out = {root}, deque([root]), []
    while queue:
        p = queue.popleft()
        for c in near.get(p, ()):
            if c not in seen:
                seen.add(c)
                queue.append(c)
                out.append((p, c))
    return out


def parents(edges: list[tuple[int, int]], n: int, root: int = 0) -> dict[int, int | None]:
    """Each scene's parent; None for the root and for what it can't reach."""
    return dict.fromkeys(range(n)) | {c: p for p, c in spanning_tree(edges, root)}


def tree_levels(edges: DataFrame, root: int = 0) -> DataFrame:
    """parent, child, level of the breadth-first tree over edges (i, j) in their order; the edges are a row a pair of scenes."""
    level, rows = {root: 0}, []
    for p, c in spanning_tree([(r["i"], r["j"]) for r in edges.select("i", "j").orderBy("i", "j").collect()], root):
        level[c] = level[p] + 1
        rows.append((p, c, level[c]))
    return edges.sparkSession.createDataFrame(rows, "parent int, child int, level int")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (its least node): minima spread along edges and jump to the label's label until nothing moves."""
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).unionByName(edges.select(F.col(dst).alias("a"), F.col(src).alias("b")))
    both = both.distinct().persist()
    label = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node")
    while True:
        seen = label.withColumnsRenamed({"node": "b", "c": "cb"})
        spread = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("cb").alias("m"))
        new = label.join(spread, "node").select("node", F.least("c", "m").alias("c"))
        jump = new.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = new.join(jump, "c").select("node", F.least("c", "cc").alias("c"))
        new = kept(new)
        still = new.join(label.withColumnRenamed("c", "was"), "node").filter("c <> was").isEmpty()
        label = new
        if still:
            break
    return label.select("node", F.col("c").alias("component"))


def loops3(edges: DataFrame) -> DataFrame:
    """x, y, z, dx, dy: triangles x < y < z and the shift left over after going round; edges are i < j with dx, dy from i to j."""
    e = lambda p: edges.select(*[F.col(c).alias(f"{p}{c}") for c in ("i", "j", "dx", "dy")])
    two = e("p").join(e("q"), F.col("pj") == F.col("qi")).join(e("r"), (F.col("ri") == F.col("pi")) & (F.col("rj") == F.col("qj")))
    return two.select(F.col("pi").alias("x"), F.col("pj").alias("y"), F.col("qj").alias("z"), *[(F.col(f"p{d}") + F.col(f"q{d}") - F.col(f"r{d}")).alias(d) for d in ("dx", "dy")])


def loops4(edges: DataFrame) -> DataFrame:
    """nodes (sorted), dx, dy: four-node loops, each set of nodes once, in the order of least path."""
    both = edges.select("i", "j", "dx", "dy").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")))
    e = lambda p: both.select(*[F.col(c).alias(f"{p}{c}") for c in ("i", "j", "dx", "dy")])
    path = e("p").join(e("q"), F.col("pj") == F.col("qi")).join(e("r"), F.col("qj") == F.col("ri")).join(e("s"), (F.col("rj") == F.col("si")) & (F.col("sj") == F.col("pi")))
    once = path.filter("pi < pj AND pi < qj AND pi < rj AND pj < rj AND pi <> qj AND pj <> rj AND pj <> qj")
    nodes = F.array_sort(F.array("pi", "pj", "qj", "rj"))
    loops = once.select(nodes.alias("nodes"), F.array("pi", "pj", "qj", "rj").alias("path"), *[(F.col(f"p{d}") + F.col(f"q{d}") + F.col(f"r{d}") + F.col(f"s{d}")).alias(d) for d in ("dx", "dy")])
    return loops.groupBy("nodes").agg(F.min_by(F.struct("dx", "dy"), "path").alias("s")).select("nodes", "s.dx", "s.dy")


def network_adjustment(pairs: list[dict], n: int, root: int = 0) -> tuple[np.ndarray, list[dict]]:
    """Shifts x (n x 2) of weighted least squares x_j - x_i = shift_ij, weights confidence * blocks / max(rmse, 0.1), the root held by weight 1000, by sparse conjugate gradients; and each pair's residual."""
    i, j = (np.array([p[k] for p in pairs], int) for k in "ij")
    shift = np.array([[p["dx"], p["dy"]] for p in pairs]).reshape(-1, 2)
    w = np.sqrt([*(p["confidence"] * p["n_blocks"] / max(p["rmse"], 0.1) for p in pairs), 1000.0])
    k, m = np.arange(len(i)), len(i)
    system = Sparse(np.concatenate([k, k, [m]]), np.concatenate([i, j, [root]]), np.concatenate([-w[:-1], w[:-1], w[-1:]]), (m + 1, n))
    x = np.column_stack([conjugate_gradients(lambda v: system.T @ (system @ v), system.T @ (w * np.append(d, 0.0)), np.zeros(n), 1e-15, 20 * n + 100) for d in shift.T])
    tree = {frozenset(e) for e in spanning_tree([(p["i"], p["j"]) for p in pairs], root)}
    left = [{"i": p["i"], "j": p["j"], "rx": float(x[p["j"], 0] - x[p["i"], 0] - p["dx"]), "ry": float(x[p["j"], 1] - x[p["i"], 1] - p["dy"]), "is_tree": frozenset((p["i"], p["j"])) in tree} for p in pairs]
    return x, left
