"""Affine and bounding-box columns.

An affine is six columns a, b, c, d, e, f: x = a col + b row + c, y = d col + e row + f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AFFINE = ("a", "b", "c", "d", "e", "f")


def _col(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def apply(prefix: str, row: Column, col: Column) -> tuple[Column, Column]:
    """x, y of a pixel corner."""
    a, b, c, d, e, f = (_col(prefix, n) for n in AFFINE)
    return a * col + b * row + c, d * col + e * row + f


def inverse(prefix: str, x: Column, y: Column) -> tuple[Column, Column]:
    """row, col of a point."""
    a, b, c, d, e, f = (_col(prefix, n) for n in AFFINE)
    det = a * e - b * d
    col = (e * (x - c) - b * (y - f)) / det
    row = (a * (y - f) - d * (x - c)) / det
    return row, col


def bounds(prefix: str, rows: Column, cols: Column) -> dict[str, Column]:
    """l, b, r, t of a raster: over its four corners, so that rotated affines are right too."""
    corners = [apply(prefix, r, c) for r in (F.lit(0), rows) for c in (F.lit(0), cols)]
    xs, ys = [x for x, _ in corners], [y for _, y in corners]
    return {"l": F.least(*xs), "bt": F.least(*ys), "r": F.greatest(*xs), "t": F.greatest(*ys)}


def overlaps(p: str, q: str) -> Column:
    """Intersection of positive area; touching edges don't overlap."""
    return (_col(p, "l") < _col(q, "r")) & (_col(q, "l") < _col(p, "r")) & (_col(p, "bt") < _col(q, "t")) & (_col(q, "bt") < _col(p, "t"))


def intersection(p: str, q: str) -> dict[str, Column]:
    return {"l": F.greatest(_col(p, "l"), _col(q, "l")), "bt": F.greatest(_col(p, "bt"), _col(q, "bt")), "r": F.least(_col(p, "r"), _col(q, "r")), "t": F.least(_col(p, "t"), _col(q, "t"))}


def window_of(prefix: str, box: dict[str, Column]) -> dict[str, Column]:
    """r0, r1, c0, c1 (ends exclusive) of the pixels that a box covers: floor and ceiling over its four corners, starts not below 0."""
    corners = [inverse(prefix, x, y) for x in (box["l"], box["r"]) for y in (box["bt"], box["t"])]
    rows, cols = [r for r, _ in corners], [c for _, c in corners]
    near, far = (lambda xs: F.greatest(F.lit(0), F.floor(F.least(*xs))).cast("int")), (lambda xs: F.ceil(F.greatest(*xs)).cast("int"))
    return {"r0": near(rows), "r1": far(rows), "c0": near(cols), "c1": far(cols)}
