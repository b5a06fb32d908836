"""Intervals on a line and on the circle, rectangles of them, and caps, as structs and expressions.

An interval is a struct (lo, hi). On a line it is empty if lo > hi. On the circle, in radians from -pi to pi, lo > hi goes through the wrap; the
empty one is (pi, -pi), the full one (-pi, pi). A rectangle is a struct of two intervals. A cap is a struct (axis, height), empty below height 0
and full from 2 on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TURN = math.pi, 2 * math.pi
EARTH_KM = 6371.0


def interval(lo, hi) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(as_column(lo).alias("lo"), as_column(hi).alias("hi"))


# On a line


def r1_is_empty(a: Column) -> Column:
    return a["lo"] > a["hi"]


def r1_from_pair(p: Column, q: Column) -> Column:
    return interval(F.least(p, q), F.greatest(p, q))


def r1_center(a: Column) -> Column:
    return (a["lo"] + a["hi"]) / 2


def r1_length(a: Column) -> Column:
    return a["hi"] - a["lo"]


def r1_contains(a: Column, p: Column) -> Column:
    return (p >= a["lo"]) & (p <= a["hi"])


def r1_interior_contains(a: Column, p: Column) -> Column:
    return (p > a["lo"]) & (p < a["hi"])


def r1_contains_interval(a: Column, b: Column) -> Column:
    return r1_is_empty(b) | ((b["lo"] >= a["lo"]) & (b["hi"] <= a["hi"]))


def r1_intersects(a: Column, b: Column) -> Column:
    return (F.greatest(a["lo"], b["lo"]) <= F.least(a["hi"], b["hi"])) & ~r1_is_empty(a) & ~r1_is_empty(b)


def r1_interior_intersects(a: Column, b: Column) -> Column:
    return (b["lo"] < a["hi"]) & (a["lo"] < b["hi"]) & (a["lo"] < a["hi"]) & ~r1_is_empty(b)


def r1_add_point(a: Column, p: Column) -> Column:
    return F.when(r1_is_empty(a), interval(p, p)).otherwise(interval(F.least(a["lo"], p), F.greatest(a["hi"], p)))


def r1_expanded(a: Column, radius) -> Column:
    return F.when(r1_is_empty(a), a).otherwise(interval(a["lo"] - radius, a["hi"] + radius))


def r1_union(a: Column, b: Column) -> Column:
    return F.when(r1_is_empty(a), b).when(r1_is_empty(b), a).otherwise(interval(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"])))


def r1_intersection(a: Column, b: Column) -> Column:
    return interval(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"]))


def r1_hausdorff(a: Column, b: Column) -> Column:
    """How far a point of the first lies from the second at most."""
    far = F.greatest(F.lit(0.0), a["hi"] - b["hi"], b["lo"] - a["lo"])
    return F.when(r1_is_empty(a), 0.0).when(r1_is_empty(b), float("inf")).otherwise(far)


# On the circle


def s1_is_empty(a: Column) -> Column:
    return (a["lo"] == PI) & (a["hi"] == -PI)


def s1_is_full(a: Column) -> Column:
    return (a["lo"] == -PI) & (a["hi"] == PI)


def s1_inverted(a: Column) -> Column:
    return a["lo"] > a["hi"]


def positive_distance(a: Column, b: Column) -> Column:
    """How far one goes up from a to b."""
    return F.when(b >= a, b - a).otherwise(b - a + TURN)


def s1_from_pair(p: Column, q: Column) -> Column:
    """The shorter of the two intervals between points."""
    return F.when(positive_distance(p, q) <= PI, interval(p, q)).otherwise(interval(q, p))


def s1_length(a: Column) -> Column:
    """-1 for the empty interval."""
    return F.when(s1_is_empty(a), -1.0).otherwise(F.when(s1_inverted(a), a["hi"] - a["lo"] + TURN).otherwise(a["hi"] - a["lo"]))


def s1_center(a: Column) -> Column:
    middle = (a["lo"] + a["hi"]) / 2
    return F.when(~s1_inverted(a), middle).when(middle <= 0, middle + PI).otherwise(middle - PI)


def s1_contains(a: Column, p: Column) -> Column:
    return F.when(s1_inverted(a), ((p >= a["lo"]) | (p <= a["hi"])) & ~s1_is_empty(a)).otherwise((p >= a["lo"]) & (p <= a["hi"]))


def s1_interior_contains(a: Column, p: Column) -> Column:
    return F.when(s1_inverted(a), (p > a["lo"]) | (p < a["hi"])).otherwise(((p > a["lo"]) & (p < a["hi"])) | s1_is_full(a))


def s1_complement(a: Column) -> Column:
    """What the interval leaves; its ends belong to both."""
    return F.when(a["lo"] == a["hi"], interval(-PI, PI)).otherwise(interval(a["hi"], a["lo"]))


def s1_intersects(a: Column, b: Column) -> Column:
    either = s1_inverted(a) | s1_inverted(b)
    touch = (b["lo"] <= a["hi"]) | (b["hi"] >= a["lo"])
    both = s1_inverted(a) & s1_inverted(b)
    return ~s1_is_empty(a) & ~s1_is_empty(b) & F.when(both, True).when(either, touch).otherwise((b["lo"] <= a["hi"]) & (b["hi"] >= a["lo"]))


def s1_contains_interval(a: Column, b: Column) -> Column:
    inverted = F.when(s1_inverted(b), (b["lo"] >= a["lo"]) & (b["hi"] <= a["hi"])).otherwise(((b["lo"] >= a["lo"]) | (b["hi"] <= a["hi"])) & ~s1_is_empty(a))
    return s1_is_empty(b) | F.when(s1_inverted(a), inverted).otherwise(F.when(s1_inverted(b), s1_is_full(a)).otherwise((b["lo"] >= a["lo"]) & (b["hi"] <= a["hi"])))


def s1_add_point(a: Column, p: Column) -> Column:
    """The end that is nearer moves."""
    nearer = positive_distance(p, a["lo"]) < positive_distance(a["hi"], p)
    return F.when(s1_contains(a, p), a).when(s1_is_empty(a), interval(p, p)).when(nearer, interval(p, a["hi"])).otherwise(interval(a["lo"], p))


def _wrapped(x: Column) -> Column:
    return x - TURN * F.rint(x / TURN)


def s1_expanded(a: Column, radius: float) -> Column:
    lo, hi = _wrapped(a["lo"] - radius), _wrapped(a["hi"] + radius)
    return F.when(s1_is_empty(a), a).when(s1_length(a) + 2 * radius >= TURN - 1e-15, interval(-PI, PI)).otherwise(interval(F.when(lo <= -PI, PI).otherwise(lo), hi))


def s1_union(a: Column, b: Column) -> Column:
    """The shortest interval that holds both."""
    first, last = s1_contains(a, b["lo"]), s1_contains(a, b["hi"])
    nearer = positive_distance(b["hi"], a["lo"]) < positive_distance(a["hi"], b["lo"])
    apart = F.when(s1_is_empty(a) | s1_contains(b, a["lo"]), b).when(nearer, interval(b["lo"], a["hi"])).otherwise(interval(a["lo"], b["hi"]))
    both = F.when(s1_contains_interval(a, b), a).otherwise(interval(-PI, PI))
    return F.when(s1_is_empty(b), a).when(first & last, both).when(first, interval(a["lo"], b["hi"])).when(last, interval(b["lo"], a["hi"])).otherwise(apart)


def s1_intersection(a: Column, b: Column) -> Column:
    """The shortest interval that holds what both have."""
    first, last = s1_contains(a, b["lo"]), s1_contains(a, b["hi"])
    both = F.when(s1_length(b) < s1_length(a), b).otherwise(a)
    out = F.when(first & last, both).when(first, interval(b["lo"], a["hi"])).when(last, interval(a["lo"], b["hi"])).when(s1_contains(b, a["lo"]), a)
    return F.when(s1_is_empty(b), b).otherwise(out.otherwise(interval(PI, -PI)))


# Rectangles of latitudes (a line) and longitudes (a circle), in radians


def rect(lat: Column, lng: Column) -> Column:
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def rect_is_empty(a: Column) -> Column:
    return r1_is_empty(a["lat"])


def rect_contains_point(a: Column, lat: Column, lng: Column) -> Column:
    return r1_contains(a["lat"], lat) & s1_contains(a["lng"], lng)


def rect_contains(a: Column, b: Column) -> Column:
    return r1_contains_interval(a["lat"], b["lat"]) & s1_contains_interval(a["lng"], b["lng"])


def rect_intersects(a: Column, b: Column) -> Column:
    return r1_intersects(a["lat"], b["lat"]) & s1_intersects(a["lng"], b["lng"])


def rect_union(a: Column, b: Column) -> Column:
    return rect(r1_union(a["lat"], b["lat"]), s1_union(a["lng"], b["lng"]))


def rect_intersection(a: Column, b: Column) -> Column:
    """Empty in both if it is in one."""
    lat, lng = r1_intersection(a["lat"], b["lat"]), s1_intersection(a["lng"], b["lng"])
    return F.when(r1_is_empty(lat) | s1_is_empty(lng), rect(interval(1.0, 0.0), interval(PI, -PI))).otherwise(rect(lat, lng))


def rect_expanded(a: Column, lat: float, lng: float) -> Column:
    by = r1_expanded(a["lat"], lat)
    return rect(interval(F.greatest(by["lo"], F.lit(-PI / 2)), F.least(by["hi"], F.lit(PI / 2))), s1_expanded(a["lng"], lng))


def rect_area(a: Column) -> Column:
    """In steradians."""
    return F.when(rect_is_empty(a), 0.0).otherwise(s1_length(a["lng"]) * F.abs(F.sin(a["lat"]["hi"]) - F.sin(a["lat"]["lo"])))


def rect_center(a: Column) -> Column:
    return F.struct(r1_center(a["lat"]).alias("lat"), s1_center(a["lng"]).alias("lng"))


# Flat rectangles


def r2_contains(a: Column, x: Column, y: Column) -> Column:
    return r1_contains(a["x"], x) & r1_contains(a["y"], y)


def r2_intersection(a: Column, b: Column) -> Column:
    x, y = r1_intersection(a["x"], b["x"]), r1_intersection(a["y"], b["y"])
    none = interval(1.0, 0.0)
    return F.when(r1_is_empty(x) | r1_is_empty(y), F.struct(none.alias("x"), none.alias("y"))).otherwise(F.struct(x.alias("x"), y.alias("y")))


def r2_union(a: Column, b: Column) -> Column:
    return F.struct(r1_union(a["x"], b["x"]).alias("x"), r1_union(a["y"], b["y"]).alias("y"))


# Caps


def cap(axis: Column, height: Column) -> Column:
    return F.struct(axis.alias("axis"), height.alias("height"))


def cap_from_angle(axis: Column, angle: Column) -> Column:
    return cap(axis, F.when(angle < 0, -1.0).otherwise(2 * F.pow(F.sin(F.least(angle, F.lit(PI)) / 2), 2)))


def cap_from_area(axis: Column, area: Column) -> Column:
    return cap(axis, area / TURN)


def cap_area(c: Column) -> Column:
    return TURN * F.greatest(F.lit(0.0), c["height"])


def cap_angle(c: Column) -> Column:
    """-1 for an empty cap."""
    return F.when(c["height"] < 0, -1.0).otherwise(2 * F.asin(F.sqrt(F.least(F.lit(1.0), c["height"] / 2))))


def cap_complement(c: Column) -> Column:
    back = F.struct(*[(-c["axis"][k]).alias(k) for k in "xyz"])
    return cap(back, F.when(c["height"] >= 2, -1.0).otherwise(2 - F.greatest(c["height"], F.lit(0.0))))


def between_axes(a: Column, b: Column) -> Column:
    """Angle between unit vectors."""
    x, y, z = a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]
    return F.atan2(F.sqrt(x * x + y * y + z * z), a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"])


def cap_intersects(a: Column, b: Column) -> Column:
    return (a["height"] >= 0) & (b["height"] >= 0) & (cap_angle(a) + cap_angle(b) >= between_axes(a["axis"], b["axis"]))


def cap_contains_cap(a: Column, b: Column) -> Column:
    return (a["height"] >= 2) | (b["height"] < 0) | (cap_angle(a) >= between_axes(a["axis"], b["axis"]) + cap_angle(b))


def cap_add_point(c: Column, p: Column) -> Column:
    """As high as the point needs; an empty cap becomes the point."""
    d = F.pow(c["axis"]["x"] - p["x"], 2) + F.pow(c["axis"]["y"] - p["y"], 2) + F.pow(c["axis"]["z"] - p["z"], 2)
    return F.when(c["height"] < 0, cap(p, F.lit(0.0))).otherwise(cap(c["axis"], F.greatest(c["height"], d / 2)))


def cap_expanded(c: Column, distance: float) -> Column:
    return F.when(c["height"] < 0, c).otherwise(cap_from_angle(c["axis"], cap_angle(c) + distance))


def cap_rect(c: Column) -> Column:
    """The rectangle of latitudes and longitudes around a cap; all longitudes if it holds a pole."""
    a, r = c["axis"], cap_angle(c)
    lat, lng = F.atan2(a["z"], F.sqrt(a["x"] * a["x"] + a["y"] * a["y"])), F.atan2(a["y"], a["x"])
    pole = (lat + r >= PI / 2) | (lat - r <= -PI / 2)
    half = F.asin(F.least(F.lit(1.0), F.sin(r) / F.cos(lat)))
    lats = interval(F.greatest(lat - r, F.lit(-PI / 2)), F.least(lat + r, F.lit(PI / 2)))
    return F.when(c["height"] < 0, rect(interval(1.0, 0.0), interval(PI, -PI))).otherwise(rect(lats, F.when(pole, interval(-PI, PI)).otherwise(interval(_wrapped(lng - half), _wrapped(lng + half)))))


# Angles and distances on the earth


def km_to_radians(km: Column) -> Column:
    return km / EARTH_KM


def radians_to_km(angle: Column) -> Column:
    return angle * EARTH_KM


def square_km_to_steradians(area: Column) -> Column:
    return area / EARTH_KM**2


def steradians_to_square_km(area: Column) -> Column:
    return area * EARTH_KM**2


def e_degrees(degrees: Column, digits: int) -> Column:
    """Whole numbers of 10^-digits degrees: E5, E6 and E7."""
    return F.rint(degrees * 10.0**digits).cast("int")


def from_e_degrees(e: Column, digits: int) -> Column:
    return e / 10.0**digits


def normalized_angle(a: Column) -> Column:
    """In (-pi, pi]."""
    x = _wrapped(a)
    return F.when(x <= -PI, PI).otherwise(x)


# Edges


def _cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def ccw(a: Column, b: Column, c: Column) -> Column:
    """1 if the points go counter-clockwise, -1 if clockwise, 0 if they lie on one circle as far as doubles tell."""
    d = _dot(_cross(a, b), c)
    return F.when(d > 1e-15, 1).when(d < -1e-15, -1).otherwise(0)


def simple_crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether edges ab and cd cross inside both."""
    ab, cd = _cross(a, b), _cross(c, d)
    acb, cbd, bda, dac = -_dot(ab, c), -_dot(cd, b), _dot(ab, d), _dot(cd, a)
    return (acb * cbd > 0) & (acb * bda > 0) & (acb * dac > 0)


def edge_distance(p: Column, a: Column, b: Column) -> Column:
    """Angle between a point and the nearest of an edge."""
    n = _cross(a, b)
    size = F.sqrt(_dot(n, n))
    foot = (_dot(_cross(n, a), p) >= 0) & (_dot(_cross(b, n), p) >= 0) & (size > 0)
    across = F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(n, p) / F.when(size > 0, size)))))
    return F.when(foot, across).otherwise(F.least(between_axes(p, a), between_axes(p, b)))


def edge_point(a: Column, b: Column, part: Column) -> Column:
    """The point at a part of an edge's length."""
    whole = between_axes(a, b)
    s = F.sin(whole)
    fa, fb = F.sin((1 - part) * whole) / s, F.sin(part * whole) / s
    return F.when(s == 0, a).otherwise(F.struct(*[(fa * a[k] + fb * b[k]).alias(k) for k in "xyz"]))


def edge_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where crossing edges meet, as a unit vector."""
    x = _cross(_cross(a, b), _cross(c, d))
    size, side = F.sqrt(_dot(x, x)), F.when(_dot(x, a) + _dot(x, b) + _dot(x, c) + _dot(x, d) >= 0, 1.0).otherwise(-1.0)
    return F.struct(*[(side * x[k] / size).alias(k) for k in "xyz"])


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """In steradians."""
    return 2 * F.atan2(F.abs(_dot(a, _cross(b, c))), 1 + _dot(a, b) + _dot(b, c) + _dot(c, a))


def turn_angle(a: Column, b: Column, c: Column) -> Column:
    """The exterior angle at b, positive to the left."""
    x, y = _cross(a, b), _cross(b, c)
    angle = between_axes(x, y)
    return F.when(_dot(_cross(a, b), c) >= 0, angle).otherwise(-angle)
