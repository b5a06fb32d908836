"""Polylines, integrals over loops, levels by size, regions as predicates; and numbers of 128 bits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, DoubleType, StructType

from .geo import LEVELS
from .intervals import _cross, _dot, between_axes, cap_from_angle, rect_contains_point

# Polylines: arrays of unit vectors


def steps(line: Column) -> Column:
    """Lengths of the edges."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.when(F.size(line) > 1, F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), between_axes)).otherwise(F.array().cast("array<double>"))


POINT = StructType().add("x", DoubleType()).add("y", DoubleType()).add("z", DoubleType())
PLACE = StructType().add("part", DoubleType()).add("distance", DoubleType()).add("right", BooleanType()).add("point", POINT)


def _lines(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices of all lines, where each line's begin, and how many it has; 0 for null."""
    size = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _vectors(lines.flatten()), np.cumsum(size) - size, size


def _vectors(points: pa.Array) -> np.ndarray:
    return np.stack([k.cast(pa.float64()).to_numpy(zero_copy_only=False) for k in points.flatten()], 1)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(-1))


def _alike(size: np.ndarray, good: np.ndarray):
    """(rows, number of vertices): lines of one length, so many at a time that they have some 65,536 vertices."""
    for n in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == n))
        for lo in range(0, len(rows), max(1, (1 << 16) // n)):
            yield rows[lo : lo + max(1, (1 << 16) // n)], n


def _placed(v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each of lines (rows, vertices, 3) is nearest to a point: part, distance, whether that is to the right, and the place; the first of edges that are as near."""
    if v.shape[1] < 2:
        return np.zeros(len(v)), _between(v[:, 0], p), np.zeros(len(v), bool), v[:, 0]
    a, b, q = v[:, :-1], v[:, 1:], p[:, None]
    n = np.cross(a, b)
    long = np.linalg.norm(n, axis=2)
    flat = q - ((n * q).sum(2) / np.where(long > 0, long**2, 1))[:, :, None] * n
    flat /= np.maximum(np.linalg.norm(flat, axis=2, keepdims=True), 1e-300)
    foot = ((np.cross(n, a) * q).sum(2) > 0) & ((np.cross(b, n) * q).sum(2) > 0) & (long > 0)
    ends = np.where((_between(a, q) <= _between(b, q))[:, :, None], a, b)
    near = np.where(foot[:, :, None], flat, ends)
    far = _between(near, q)
    k, row = far.argmin(1), np.arange(len(v))
    lengths = _between(a, b)
    before, whole = np.cumsum(lengths, 1) - lengths, lengths.sum(1)
    part = np.where(whole > 0, (before[row, k] + _between(a[row, k], near[row, k])) / np.where(whole > 0, whole, 1.0), 0.0)
    return part, far[row, k], (n[row, k] * p).sum(1) < 0, near[row, k]


@arrow_udf(PLACE)
def place(line: pa.Array, p: pa.Array) -> pa.Array:
    """The part of a line's length at which it is nearest to a point, how far that is, whether the point lies to the right, and the line's point."""
    vertices, start, size = _lines(line)
    known = (size > 0) & p.is_valid().to_numpy(zero_copy_only=False)
    q = _vectors(p)
    part, distance, right, point = np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), bool), np.zeros((len(size), 3))
    for rows, n in _alike(size, known):
        part[rows], distance[rows], right[rows], point[rows] = _placed(vertices[start[rows, None] + np.arange(n)], q[rows])
    made = [pa.array(part), pa.array(distance), pa.array(right, mask=size < 2), pa.StructArray.from_arrays([pa.array(point[:, k]) for k in range(3)], list("xyz"))]
    return pa.StructArray.from_arrays(made, ["part", "distance", "right", "point"], mask=pa.array(~known))


@arrow_udf(POINT)
def interpolate(line: pa.Array, part: pa.Array) -> pa.Array:
    """The point at a part of the line's length, which is kept within 0 and 1."""
    vertices, start, size = _lines(line)
    known = (size > 0) & part.is_valid().to_numpy(zero_copy_only=False)
    f, out = np.clip(part.fill_null(0).to_numpy(zero_copy_only=False).astype(float), 0.0, 1.0), np.zeros((len(size), 3))
    for rows, n in _alike(size, known):
        v, row = vertices[start[rows, None] + np.arange(n)], np.arange(len(rows))
        lengths = _between(v[:, :-1], v[:, 1:])
        far = np.concatenate((np.zeros((len(v), 1)), np.cumsum(lengths, 1)), 1)
        to = f[rows] * lengths.sum(1)
        k = np.minimum((far <= to[:, None]).sum(1) - 1, max(n - 2, 0))
        a, b, w = v[row, k], v[row, np.minimum(k + 1, n - 1)], lengths[row, k] if n > 1 else np.zeros(len(v))
        some = np.where(w > 0, w, 1.0)
        t = ((to - far[row, k]) / some)[:, None]
        q = (np.sin((1 - t) * some[:, None]) * a + np.sin(t * some[:, None]) * b) / np.sin(some)[:, None]
        out[rows] = np.where((w > 0)[:, None], q, a)
    return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(3)], list("xyz"), mask=pa.array(~known))


def uninterpolate(line: Column, p: Column) -> Column:
    """The part of the line's length at which it is nearest to a point; 0 for a line without length."""
    return place(line, p)["part"]


def project(line: Column, p: Column) -> Column:
    """The line's point that is nearest."""
    return place(line, p)["point"]


def is_right(line: Column, p: Column) -> Column:
    """Whether a point lies to the right of the nearest edge."""
    return place(line, p)["right"]


def line_distance(line: Column, p: Column) -> Column:
    return place(line, p)["distance"]


@arrow_udf(BooleanType())
def nearly_covers(line: pa.Array, other: pa.Array, error: pa.Array) -> pa.Array:
    """Whether every vertex of the other line lies within an angle of the line, in its order along it."""
    out = []
    (v, at, n), (w, to, m) = _lines(line), _lines(other)
    for k, (known, e) in enumerate(zip(other.is_valid().to_pylist(), error.to_pylist())):
        if not n[k] or not known or e is None:
            out.append(None)
            continue
        held = [_placed(v[None, at[k] : at[k] + n[k]], q[None]) for q in w[to[k] : to[k] + m[k]]]
        part, distance = (np.array([x[i][0] for x in held]) for i in (0, 1))
        out.append(bool((distance <= e).all() and (part[:-1] <= part[1:] + 1e-12).all()))
    return pa.array(out, pa.bool_())


def approx_equal(line: Column, other: Column, error: float) -> Column:
    return (F.size(line) == F.size(other)) & F.forall(F.zip_with(line, other, between_axes), lambda x: F.coalesce(x <= error, F.lit(False)))


# Integrals over loops, and centroids


def surface_integral(loop: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """The sum of f over the triangles that a loop's first vertex makes with its edges; f has a sign where a triangle goes clockwise."""
    k = F.when(F.size(loop) > 2, F.sequence(F.lit(2), F.greatest(F.size(loop) - 1, F.lit(2)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(k, lambda i: f(loop[0], F.element_at(loop, i), F.element_at(loop, i + 1))), F.lit(0.0), lambda s, x: s + x)


def signed_area(a: Column, b: Column, c: Column) -> Column:
    """Area of a triangle, negative if it goes clockwise."""
    return 2 * F.atan2(_dot(a, _cross(b, c)), 1 + _dot(a, b) + _dot(b, c) + _dot(c, a))


def planar_centroid(loop: Column) -> Column:
    """The mean of the vertices, as a unit vector."""
    total = {k: F.aggregate(loop, F.lit(0.0), lambda s, v, k=k: s + v[k]) for k in "xyz"}
    size = F.sqrt(sum((t * t for t in list(total.values())[1:]), total["x"] * total["x"]))
    return F.struct(*[(t / size).alias(k) for k, t in total.items()])


# Levels of cells by their size

#: Lengths at level 0 of the quadratic projection; a level halves them.
MIN_WIDTH, AVG_EDGE, MAX_WIDTH = 2 * 2**0.5 / 3, 1.459213746386106, 1.704897179199218


def min_level(length: Column, unit: float) -> Column:
    """The least level whose cells aren't larger."""
    return F.when(length <= 0, LEVELS).otherwise(F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(unit / length)).cast("int"))))


def max_level(length: Column, unit: float) -> Column:
    """The greatest level whose cells aren't smaller."""
    return F.when(length <= 0, LEVELS).otherwise(F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(unit / length)).cast("int"))))


def closest_level(length: Column, unit: float) -> Column:
    return min_level(2**0.5 * length, unit)


# Regions: shapes of one's own need no more than a predicate


class Region:
    """A set of points, by a predicate of a unit vector; | & ~ make others of them."""

    def __init__(self, holds: Callable[[Column], Column]):
        self.holds = holds

    def __or__(self, other: Region) -> Region:
        return Region(lambda p: self.holds(p) | other.holds(p))

    def __and__(self, other: Region) -> Region:
        return Region(lambda p: self.holds(p) & other.holds(p))

    def __invert__(self) -> Region:
        return Region(lambda p: ~self.holds(p))


def cap_region(axis: Column, angle: float) -> Region:
    c = cap_from_angle(axis, F.lit(angle))
    return Region(lambda p: sum(((p[k] - axis[k]) * (p[k] - axis[k]) for k in "yz"), (p["x"] - axis["x"]) * (p["x"] - axis["x"])) <= 2 * c["height"])


def rect_region(rect: Column) -> Region:
    return Region(lambda p: rect_contains_point(rect, F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p["z"]))), F.atan2(p["y"], p["x"])))


def point_region(q: Column) -> Region:
    return Region(lambda p: (p["x"] == q["x"]) & (p["y"] == q["y"]) & (p["z"] == q["z"]))


# Whole numbers of up to 38 digits


_TWO64 = "cast('18446744073709551616' as decimal(20,0))"


def wide(high: Column, low: Column) -> Column:
    """high * 2^64 + low, both taken as unsigned; numbers beyond 38 digits are an error."""
    two64 = F.expr(_TWO64)
    unsigned = lambda c: F.when(c < 0, c.cast("decimal(20,0)") + two64).otherwise(c.cast("decimal(20,0)"))
    return (unsigned(high).cast("decimal(18,0)") * two64 + unsigned(low)).cast("decimal(38,0)")


def wide_low(c: Column) -> Column:
    """The last 64 bits."""
    part = (c % F.expr(_TWO64)).cast("decimal(20,0)")
    return F.when(part >= F.expr("cast('9223372036854775808' as decimal(20,0))"), part - F.expr(_TWO64)).otherwise(part).cast("bigint")
