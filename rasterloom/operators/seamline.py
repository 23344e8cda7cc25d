"""Least-cost seams of overlaps of any size: one place in each line, a step of one place aside at most, the leftmost of equals.

An overlap is cut into strips of lines.  A strip's transfer matrix holds the least cost from each place
in its first line to each place in its last one, only where lines suffice to get there (a band).
Min-plus products join the matrices of neighbouring strips, FAN at a time, level by level; then each
level hands the costs of all that lies before to its strips, so every strip knows the costs it starts
with, finds the strip's part of every best path, and the chosen path is traced in all strips at once.
No task holds an overlap: a strip's matrix has some 2 STRIP x width numbers, joint ones up to width^2,
and a pair's exits (an integer for each place and strip) are followed by one task.

Costs are fixed-point integers, so sums don't depend on how an overlap is cut.  Their unit is the
pair's greatest cost / 2^b with the largest b that keeps every sum under 2^60, one cell without data
counting more than all others together: 2^-36 of the greatest cost for 4,000 lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pixels import kept, small

STRIP, FAN, NEVER = 64, 8, 1 << 61
GRADIENT = 0.5


def unit(lines: int) -> int:
    """b: a valid cell's cost is at most 2^b."""
    return 60 - 2 * int(lines + 1).bit_length()


def sobel_parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Absolute 3 x 3 Sobel derivatives of values with a halo of 1."""
    d, s = m[:, 2:] - m[:, :-2], m[2:] - m[:-2]
    return np.abs(d[:-2] + 2 * d[1:-1] + d[2:]), np.abs(s[:, :-2] + 2 * s[:, 1:-1] + s[:, 2:])


def costs(a: np.ndarray, b: np.ndarray, diff: float = 1.0, grad: float = GRADIENT) -> np.ndarray:
    """|a - b| and the length of the difference of absolute gradients, from values with a halo of 1; NaN where either is."""
    (ax, ay), (bx, by) = sobel_parts(np.nan_to_num(a)), sobel_parts(np.nan_to_num(b))
    return diff * np.abs(a - b)[1:-1, 1:-1] + grad * np.hypot(ax - bx, ay - by)


def fixed(cost: np.ndarray, most: float, lines: int) -> np.ndarray:
    """Costs as integers; cells without data cost more than a path of valid ones."""
    b = unit(lines)
    share = np.floor(np.nan_to_num(cost) / (most if most > 0 else 1.0) * float(1 << b) + 0.5).astype(np.int64)
    return np.where(np.isnan(cost), lines * (1 << b) + 1, share)


def linked(v: np.ndarray) -> np.ndarray:
    """The least of each place and its neighbours, along the last axis."""
    p = np.pad(v, [(0, 0)] * (v.ndim - 1) + [(1, 1)], constant_values=NEVER)
    return np.minimum(np.minimum(p[..., :-2], p[..., 1:-1]), p[..., 2:])


def transfer(c: np.ndarray) -> np.ndarray:
    """Least costs from each place e of the first line to place e + k - (n - 1) of the last, the first line's cost included."""
    n, w = c.shape
    t = np.full((w, 2 * n - 1), NEVER)
    t[:, n - 1] = c[0]
    for r in range(1, n):
        line = np.lib.stride_tricks.sliding_window_view(np.pad(c[r], n - 1, constant_values=NEVER), 2 * n - 1)
        t = np.minimum(linked(t) + line, NEVER)
    return narrowed(t)


def narrowed(t: np.ndarray) -> np.ndarray:
    """No path goes further aside than the line is wide."""
    over = t.shape[1] // 2 - (t.shape[0] - 1)
    return t[:, over:-over] if over > 0 else t


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The transfer matrix of two strips, one after the other."""
    w = len(a)
    a = linked(np.pad(a, ((0, 0), (1, 1)), constant_values=NEVER))
    h, width = a.shape[1] // 2, b.shape[1]
    out = np.full((w, a.shape[1] + width - 1), NEVER)
    for k in range(a.shape[1]):
        lo, hi = max(0, h - k), min(w, w + h - k)  # places from which k leads to a place
        if lo < hi:
            part = out[lo:hi, k : k + width]
            np.minimum(part, a[lo:hi, k, None] + b[lo + k - h : hi + k - h], out=part)
    return narrowed(np.minimum(out, NEVER))


def passed(v: np.ndarray | None, t: np.ndarray) -> np.ndarray:
    """Least costs at the places of a strip's last line, from those of the line before the strip (None: it is the first)."""
    w, h = len(t), t.shape[1] // 2
    at = np.zeros(w, np.int64) if v is None else linked(v)
    out = np.full(w + 2 * h, NEVER)
    for k in range(t.shape[1]):
        np.minimum(out[k : k + w], at + t[:, k], out=out[k : k + w])
    return np.minimum(out[h : h + w], NEVER)


def steps(c: np.ndarray, v: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Costs at the last line, and for each line and place the place before it (the first line's: in the line before the strip)."""
    n, w = c.shape
    back, total = np.zeros((n, w), np.int32), np.zeros(w, np.int64)
    for r in range(n):
        if r or v is not None:
            p = np.pad(total if r else v, 1, constant_values=NEVER)
            three = np.stack([p[:-2], p[1:-1], p[2:]])
            step = three.argmin(0)
            back[r], total = np.arange(w) + step - 1, np.take_along_axis(three, step[None], 0)[0]
        total = np.minimum(total + c[r], NEVER)
    return total, back


def followed(back: np.ndarray, place: int) -> tuple[np.ndarray, int]:
    """The places of the lines of a path that ends at place, and the place before the first line."""
    path = np.empty(len(back), np.int64)
    for r in range(len(back) - 1, -1, -1):
        path[r], place = place, int(back[r][place])
    return path, place


def min_cost_seam(a: np.ndarray, b: np.ndarray, ok_a: np.ndarray, ok_b: np.ndarray, diff: float = 1.0, grad: float = GRADIENT) -> np.ndarray:
    """One column a row, for arrays that are at hand.  With fewer jointly valid pixels than rows, the column that has most of them."""
    both = ok_a & ok_b
    if both.sum() < len(both):
        return np.full(len(both), int(both.sum(0).argmax()))
    x, y = (np.pad(np.where(ok, m, 0.0), 1, mode="edge") for m, ok in ((a, ok_a), (b, ok_b)))
    cost = np.where(both, costs(x, y, diff, grad), np.nan)
    total, back = steps(fixed(cost, float(np.nanmax(cost)), len(cost)), None)
    return followed(back, int(total.argmin()))[0]


# -- the same on strips


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _strip_costs(strip: int):  # noqa: ANN202
    """Cells of a strip and its neighbouring lines to the strip's costs."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        one = g.iloc[0]
        k, lines, w = int(one["k"]), int(one["lines"]), int(one["short"])
        first, last = k * strip, min(lines, (k + 1) * strip) - 1
        lo, hi = max(0, first - 1), min(lines - 1, last + 1)
        a, b = (np.full((hi - lo + 1, w), np.nan) for _ in "ab")
        at = g["l"].to_numpy() - lo, g["s"].to_numpy()
        a[at], b[at] = g["va"], g["vb"]
        pad = ((int(lo == first), int(hi == last)), (1, 1))
        ok = ~(np.isnan(a) | np.isnan(b))
        x, y = (np.pad(np.nan_to_num(m), pad, mode="edge") for m in (a, b))
        own = slice(first - lo, first - lo + last - first + 1)
        cost = np.where(ok[own], costs(x, y), np.nan)
        most = float(np.nanmax(cost)) if ok[own].any() else 0.0
        return pd.DataFrame({"i": [one["i"]], "j": [one["j"]], "k": [k], "n": [len(cost)], "most": [most], "cost": [cost.astype("<f8").tobytes()]})

    return run


def _transfers(g: pd.DataFrame) -> pd.DataFrame:
    c = _ints(g["c"].iloc[0]).reshape(int(g["n"].iloc[0]), -1)
    return pd.DataFrame({"i": g["i"], "j": g["j"], "k": g["k"], "w": [c.shape[1]], "t": [transfer(c).astype("<i8").tobytes()]})


def _products(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("k")
    w = int(g["w"].iloc[0])
    made = None
    for t in g["t"]:
        t = _ints(t).reshape(w, -1)
        made = t if made is None else joined(made, t)
    return pd.DataFrame({"i": g["i"].iloc[:1], "j": g["j"].iloc[:1], "k": g["up"].iloc[:1], "w": [w], "t": [made.astype("<i8").tobytes()]})


def _starts(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("k")
    v = None if g["v"].iloc[0] is None else _ints(g["v"].iloc[0])
    out = []
    for t, w in zip(g["t"], g["w"]):
        out.append(None if v is None else v.astype("<i8").tobytes())
        v = passed(v, _ints(t).reshape(int(w), -1))
    return pd.DataFrame({"i": g["i"], "j": g["j"], "k": g["k"], "v": out})


def _leaf(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    one = g.iloc[0]
    return steps(_ints(one["c"]).reshape(int(one["n"]), -1), None if one["v"] is None else _ints(one["v"]))


def _maps(g: pd.DataFrame) -> pd.DataFrame:
    """Of each place of a strip's last line, the place before the strip on its best path."""
    total, back = _leaf(g)
    at = np.arange(len(total))
    for r in range(len(back) - 1, -1, -1):
        at = back[r][at]
    return pd.DataFrame({"i": g["i"], "j": g["j"], "k": g["k"], "best": [int(total.argmin())], "before": [at.astype("<i4").tobytes()]})


def _exits(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("k")
    place, out = int(g["best"].iloc[-1]), []
    for before in g["before"].iloc[::-1]:
        out.append(place)
        place = int(np.frombuffer(before, "<i4")[place])
    return pd.DataFrame({"i": g["i"], "j": g["j"], "k": g["k"], "exit": out[::-1]})


def _path(strip: int):  # noqa: ANN202
    def run(g: pd.DataFrame) -> pd.DataFrame:
        path = followed(_leaf(g)[1], int(g["exit"].iloc[0]))[0]
        return pd.DataFrame({"i": g["i"].iloc[0], "j": g["j"].iloc[0], "l": int(g["k"].iloc[0]) * strip + np.arange(len(path)), "s": path})

    return run


def _fixed(g: pd.DataFrame) -> pd.DataFrame:
    cost = np.frombuffer(g["cost"].iloc[0], "<f8").reshape(int(g["n"].iloc[0]), -1)
    c = fixed(cost, float(g["greatest"].iloc[0]), int(g["lines"].iloc[0]))
    return pd.DataFrame({"i": g["i"], "j": g["j"], "k": g["k"], "n": g["n"], "c": [c.astype("<i8").tobytes()]})


def seams(both: DataFrame, strip: int = STRIP, fan: int = FAN) -> DataFrame:
    """i, j, flat, line, sc, short, n: the seam of each pair's jointly valid cells (i, j, gr, gc, va, vb), one cell a line.

    Lines run along the longer side (rows, unless flat); short is the other side's length, n the number of cells.
    """
    pair, both = ["i", "j"], kept(both)
    box = both.groupBy(*pair).agg(F.min("gr").alias("top"), F.min("gc").alias("left"), (F.max("gr") - F.min("gr") + 1).alias("h"), (F.max("gc") - F.min("gc") + 1).alias("w"), F.count(F.lit(1)).alias("n"))
    box = kept(box.select("*", (F.col("w") > F.col("h")).alias("flat"), F.greatest("h", "w").alias("lines"), F.least("h", "w").alias("short")))
    most = box.agg(F.max("lines")).first()[0]
    near = small(box)
    placed = both.join(near, pair).withColumns({"l": F.when(F.col("flat"), F.col("gc") - F.col("left")).otherwise(F.col("gr") - F.col("top")), "s": F.when(F.col("flat"), F.col("gr") - F.col("top")).otherwise(F.col("gc") - F.col("left"))})
    few = placed.filter("n < lines").groupBy(*pair, "s").agg(F.count(F.lit(1)).alias("held")).groupBy(*pair).agg(F.max_by("s", F.struct("held", (-F.col("s")).alias("m"))).alias("s"))
    flat_seams = few.join(near, pair).select(*pair, F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("l"), "s")
    at = F.floor(F.col("l") / strip).cast("int")
    inside = F.array_distinct(F.array(at, F.floor((F.col("l") - 1) / strip).cast("int"), F.floor((F.col("l") + 1) / strip).cast("int")))
    cells = placed.filter("n >= lines").select(*pair, "l", "s", "va", "vb", "lines", "short", F.explode(inside).alias("k")).filter(f"k >= 0 AND k * {strip} < lines")
    # A strip without a valid cell of its own may get no cell at all: it stands in for itself.
    hollow = box.filter("n >= lines").select(*pair, F.lit(0).alias("l"), F.lit(0).alias("s"), F.lit(None).cast("double").alias("va"), F.lit(None).cast("double").alias("vb"), "lines", "short", F.explode(F.sequence(F.lit(0), F.floor((F.col("lines") - 1) / strip).cast("int"))).alias("k"))
    cells = cells.unionByName(hollow.withColumn("l", F.col("k") * strip)).groupBy(*pair, "k", "l", "s", "lines", "short").agg(F.max("va").alias("va"), F.max("vb").alias("vb"))
    cost = kept(cells.groupBy(*pair, "k").applyInPandas(_strip_costs(strip), "i int, j int, k int, n int, most double, cost binary"))
    greatest = cost.groupBy(*pair).agg(F.max("most").alias("greatest")).join(box.select(*pair, "lines"), pair)
    c = kept(cost.join(greatest, pair).groupBy(*pair, "k").applyInPandas(_fixed, "i int, j int, k int, n int, c binary"))
    levels, left = [], -(-(most or 1) // strip)
    if left > 1:
        levels.append(kept(c.groupBy(*pair, "k").applyInPandas(_transfers, "i int, j int, k int, w int, t binary")))
    while left > fan:
        levels.append(kept(levels[-1].withColumn("up", F.floor(F.col("k") / fan).cast("int")).groupBy(*pair, "up").applyInPandas(_products, "i int, j int, k int, w int, t binary")))
        left = -(-left // fan)
    state = None
    for level in reversed(levels):
        down = level.withColumn("up", F.floor(F.col("k") / fan).cast("int"))
        down = down.withColumn("v", F.lit(None).cast("binary")) if state is None else down.join(state.withColumnRenamed("k", "up"), [*pair, "up"])
        state = kept(down.groupBy(*pair, "up").applyInPandas(_starts, "i int, j int, k int, v binary"))
    ready = c.withColumn("v", F.lit(None).cast("binary")) if state is None else c.join(state, [*pair, "k"])
    ready = kept(ready)
    maps = ready.groupBy(*pair, "k").applyInPandas(_maps, "i int, j int, k int, best int, before binary")
    exits = maps.groupBy(*pair).applyInPandas(_exits, "i int, j int, k int, exit int")
    path = ready.join(exits, [*pair, "k"]).groupBy(*pair, "k").applyInPandas(_path(strip), "i int, j int, l int, s int")
    found = path.unionByName(flat_seams.select(*pair, F.col("l").cast("int"), F.col("s").cast("int"))).join(near, pair)
    line, sc = (F.when(F.col("flat"), F.col(f) + F.col(x)).otherwise(F.col(o) + F.col(x)).cast("int") for x, f, o in (("l", "left", "top"), ("s", "top", "left")))
    return found.select(*pair, "flat", line.alias("line"), sc.alias("sc"), F.col("short").cast("int").alias("short"), F.col("n").cast("long").alias("n"))
