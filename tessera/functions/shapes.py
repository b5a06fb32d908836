"""Shapes on the sphere: polylines as expressions, loops, polygons and sets of cells vectorised.

A loop is an array of unit vectors, counter-clockwise, within a hemisphere. A polygon is an array of loops; a point is inside if it is inside an
odd number of them. Points on a boundary may fall on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType

from .geo import LEVELS, normalize

ALL = (1 << 64) - 1


def angle(a: Column, b: Column) -> Column:
    """Angle between unit vectors."""
    cx, cy, cz = a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]
    return F.atan2(F.sqrt(cx * cx + cy * cy + cz * cz), a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"])


def length(line: Column) -> Column:
    """Length of a polyline (array of unit vectors) in radians; 0 for fewer than two."""
    steps = F.when(F.size(line) > 1, F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), angle)).otherwise(F.array().cast("array<double>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def _vertices(loop) -> np.ndarray:
    return np.array([(v["x"], v["y"], v["z"]) for v in loop], float).reshape(-1, 3)


def loop_area(v: np.ndarray) -> float:
    """Area inside in steradians, from the angles by which the boundary turns."""
    if len(v) < 3:
        return 0.0
    n = np.cross(v, np.roll(v, -1, 0))
    before = np.roll(n, 1, 0)
    sign = np.einsum("ij,ij->i", np.cross(before, n), v)
    turn = np.arctan2(sign, np.einsum("ij,ij->i", before, n))
    return float((2 * np.pi - turn.sum()) % (4 * np.pi))


def loop_contains(v: np.ndarray, p: np.ndarray) -> bool:
    """Whether the boundary winds once around the point, on its left."""
    if len(v) < 3 or v.mean(0) @ p <= -0.999999:
        return False
    helper = np.eye(3)[np.abs(p).argmin()]
    e1 = np.cross(p, helper)
    e1 /= np.linalg.norm(e1)
    e2 = np.cross(p, e1)
    w = v - np.outer(v @ p, p)
    a = np.arctan2(w @ e2, w @ e1)
    step = (np.diff(np.append(a, a[0])) + np.pi) % (2 * np.pi) - np.pi
    return bool(step.sum() > np.pi) and bool((v @ p).max() > 0)


@arrow_udf(DoubleType())
def area(loop: pa.Array) -> pa.Array:
    return pa.array([None if x is None else loop_area(_vertices(x)) for x in loop.to_pylist()], pa.float64())


@arrow_udf(DoubleType())
def polygon_area(loops: pa.Array) -> pa.Array:
    """Loops count plus or minus by how many of the others they lie in."""
    out = []
    for polygon in loops.to_pylist():
        own = [_vertices(x) for x in polygon or ()]
        depth = [sum(loop_contains(b, a[0]) for b in own if b is not a and len(a)) for a in own]
        out.append(None if polygon is None else float(sum((-1) ** d * loop_area(a) for a, d in zip(own, depth))))
    return pa.array(out, pa.float64())


@arrow_udf(BooleanType())
def polygon_contains(loops: pa.Array, point: pa.Array) -> pa.Array:
    out = []
    for polygon, p in zip(loops.to_pylist(), point.to_pylist()):
        out.append(None if polygon is None or p is None else sum(loop_contains(_vertices(x), _vertices([p])[0]) for x in polygon) % 2 == 1)
    return pa.array(out, pa.bool_())


def _spans(cells) -> list[tuple[int, int]]:
    """Ranges of leaves, half open, as unsigned numbers."""
    out: list[tuple[int, int]] = []
    for c in normalize([c for c in cells or () if c is not None]):
        u = c & ALL
        low, high = (u - (u & -u)) >> 1, (u + (u & -u)) >> 1
        if out and out[-1][1] == low:
            out[-1] = out[-1][0], high
        else:
            out.append((low, high))
    return out


def _cells(spans) -> list[int]:
    """The largest cells that make up ranges of leaves."""
    out = []
    for low, high in spans:
        while low < high:
            size = min(low & -low or 1 << 2 * LEVELS, 1 << 2 * LEVELS)
            size = 1 << (size.bit_length() - 1) // 2 * 2
            while size > high - low:
                size >>= 2
            u = 2 * low + size
            out.append(u - (1 << 64) if u >> 63 else u)
            low += size
    return out


def combine(a, b, keep) -> list[int]:
    """Cells where keep(in a, in b) holds."""
    left, right = _spans(a), _spans(b)
    edges = sorted({x for s in (*left, *right) for x in s})
    inside = lambda spans, at: any(lo <= at < hi for lo, hi in spans)
    return normalize(_cells([(x, y) for x, y in zip(edges, edges[1:]) if keep(inside(left, x), inside(right, x))]))


def _algebra(keep):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else combine(x, y, keep) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.int64()))

    return arrow_udf(run, ArrayType(LongType()))


cells_union = _algebra(lambda a, b: a or b)
cells_intersection = _algebra(lambda a, b: a and b)
cells_difference = _algebra(lambda a, b: a and not b)


def leaf_count(cells: Column) -> Column:
    """Leaves in a set of cells that don't overlap."""
    return F.aggregate(cells, F.lit(0).cast("decimal(20,0)"), lambda s, c: (s + F.shiftrightunsigned(c.bitwiseAND(-c), 0).cast("decimal(20,0)")).cast("decimal(20,0)"))
