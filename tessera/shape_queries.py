"""Queries of intervals, rectangles, caps, edges and cells; each over its whole table, with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .functions import geo, paths
from .functions import intervals as I  # noqa: E741
from .operators import edges
from .queries import C_LAT, C_LNG, LAT, LNG, coordinates, query, read

_P = f"select c_custkey, radians({C_LAT}) as a, radians({C_LNG}) as b, (c_custkey % 11 * 0.1)::double as r from customer"
_XYZ = f"select c_custkey, a, b, r, cos(a) * cos(b) as x, cos(a) * sin(b) as y, sin(a) as z from ({_P})"
TURN = 2 * math.pi
_TURN, _PI = f"{TURN!r}::double", f"{math.pi!r}::double"


def _points(spark, d):
    c = coordinates(read(spark, d, "customer"), "c_custkey")
    return c.select("c_custkey", F.radians("lat").alias("a"), F.radians("lng").alias("b"), (F.col("c_custkey") % 11 * 0.1).alias("r"), geo.point(F.col("lat"), F.col("lng")).alias("p"))


@query(f"""select c_custkey, a between -0.5 and r as has, greatest(a, -0.5) <= least(a + r, 1.0) as meets, round(greatest(a, -0.5), 9) as lo, round(least(a + r, 1.0), 9) as hi, round(least(a, -0.5), 9) as ulo, round(greatest(a + r, 1.0), 9) as uhi,
round(greatest(0, a + r - 1.0, -0.5 - a), 9) as far, round(a + r / 2, 9) as middle, round(a - 0.25, 9) as wide from ({_P})""")
def interval_r1(spark, d):
    own, other = I.interval(F.col("a"), F.col("a") + F.col("r")), I.interval(-0.5, 1.0)
    both, either = I.r1_intersection(own, other), I.r1_union(own, other)
    return _points(spark, d).select("c_custkey", I.r1_contains(I.interval(F.lit(-0.5), F.col("r")), F.col("a")).alias("has"), I.r1_intersects(own, other).alias("meets"), F.round(both["lo"], 9).alias("lo"), F.round(both["hi"], 9).alias("hi"), F.round(either["lo"], 9).alias("ulo"), F.round(either["hi"], 9).alias("uhi"),
                                    F.round(I.r1_hausdorff(own, other), 9).alias("far"), F.round(I.r1_center(own), 9).alias("middle"), F.round(I.r1_expanded(own, 0.25)["lo"], 9).alias("wide"))


@query(f"""with p as (select c_custkey, b, b + r as raw, case when b + r > {_PI} then b + r - {_TURN} else b + r end as e, r from ({_P}))
select c_custkey, case when b > e then 3.0 >= b or 3.0 <= e else 3.0 between b and e end as has, round(r, 9) as length, round(case when b + r / 2 > {_PI} then b + r / 2 - {_TURN} else b + r / 2 end, 9) as middle, round({_TURN} - r, 9) as left_over,
case when b > e then true else b <= 3.1 and e >= 2.9 end as meets from p where abs(b + r / 2 - {math.pi!r}) > 1e-6 and abs(b - {math.pi!r}) > 1e-9 and r > 0""")
def interval_s1(spark, d):
    own = I.interval(F.col("b"), F.when(F.col("b") + F.col("r") > math.pi, F.col("b") + F.col("r") - TURN).otherwise(F.col("b") + F.col("r")))
    p = _points(spark, d).where((F.abs(F.col("b") + F.col("r") / 2 - math.pi) > 1e-6) & (F.abs(F.col("b") - math.pi) > 1e-9) & (F.col("r") > 0))
    return p.select("c_custkey", I.s1_contains(own, F.lit(3.0)).alias("has"), F.round(I.s1_length(own), 9).alias("length"), F.round(I.s1_center(own), 9).alias("middle"), F.round(I.s1_length(I.s1_complement(own)), 9).alias("left_over"), I.s1_intersects(own, I.interval(2.9, 3.1)).alias("meets"))


@query(f"""with p as (select c_custkey, b, r from ({_P}) where b between -2.0 and 1.9 and r > 0)
select c_custkey, round(greatest(b + r, 0.5) - least(b, -0.5), 9) as joined, case when b <= 0.5 and b + r >= -0.5 then round(least(b + r, 0.5) - greatest(b, -0.5), 9) else -1.0 end as common from p""")
def interval_s1_sets(spark, d):
    own, other = I.interval(F.col("b"), F.col("b") + F.col("r")), I.interval(-0.5, 0.5)
    p = _points(spark, d).where((F.col("b") >= -2.0) & (F.col("b") <= 1.9) & (F.col("r") > 0))
    return p.select("c_custkey", F.round(I.s1_length(I.s1_union(own, other)), 9).alias("joined"), F.round(I.s1_length(I.s1_intersection(own, other)), 9).alias("common"))


@query(f"""select c_custkey, round(0.2 * abs(sin(least(a + 0.1, pi() / 2)) - sin(greatest(a - 0.1, -pi() / 2))), 9) as area, a + 0.1 >= 0 and a - 0.1 <= 0.5 and (b + 0.1 >= 1.0 and b - 0.1 <= 2.0) as meets from ({_P}) where abs(b) < 3""")
def rect_algebra(spark, d):
    b = F.col("b")
    point = I.rect(I.interval(F.col("a"), F.col("a")), I.interval(b, b))
    own = I.rect_expanded(point, 0.1, 0.1)
    other = I.rect(I.interval(0.0, 0.5), I.interval(1.0, 2.0))
    return _points(spark, d).where(F.abs(b) < 3).select("c_custkey", F.round(I.rect_area(own), 9).alias("area"), I.rect_intersects(own, other).alias("meets"))


@query(f"""with p as ({_XYZ}), c as (select *, 2 * pow(sin(r / 2), 2) as h, acos(greatest(-1, least(1, x))) as far from p)
select c_custkey, round(2 * pi() * h, 9) as area, round(4 * pi() - 2 * pi() * h, 9) as rest, r + 0.5 >= far as meets, r >= far + 0.01 as holds, round(greatest(h, 1 - x), 9) as grown, round(greatest(a - r, -pi() / 2), 7) as south from c where abs(r + 0.5 - far) > 1e-6""")
def cap_algebra(spark, d):
    c = I.cap_from_angle(F.col("p"), F.col("r"))
    ex = geo.point(F.lit(0.0), F.lit(0.0))
    half, small = I.cap_from_angle(ex, F.lit(0.5)), I.cap_from_angle(ex, F.lit(0.01))
    p = _points(spark, d).where(F.abs(F.col("r") + 0.5 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("p.x"))))) > 1e-6)
    return p.select("c_custkey", F.round(I.cap_area(c), 9).alias("area"), F.round(I.cap_area(I.cap_complement(c)), 9).alias("rest"), I.cap_intersects(c, half).alias("meets"), I.cap_contains_cap(c, small).alias("holds"), F.round(I.cap_add_point(c, ex)["height"], 9).alias("grown"), F.round(I.cap_rect(c)["lat"]["lo"], 7).alias("south"))


@query(f"""with p as ({_XYZ}) select c_custkey, round(case when b between 0.0 and 1.0 then abs(a) else least(acos(greatest(-1, least(1, x))), acos(greatest(-1, least(1, x * cos(1.0::double) + y * sin(1.0::double))))) end, 6) as distance,
abs(b - 0.5) < 0.5 and a > 0 as crosses, (case when abs(z) < 1e-15 then 0 when z > 0 then 1 else -1 end)::integer as side from p where a > -1.2 and abs(b) > 1e-6 and abs(b - 1) > 1e-6 and abs(z) > 1e-12""")
def edge_functions(spark, d):
    """The edge along the equator from longitude 0 to 1 (radians): distances from it, meridians over it, sides of it."""
    here = lambda lat, lng: geo.point(F.lit(math.degrees(lat)), F.lit(math.degrees(lng)))
    a, b = here(0.0, 0.0), here(0.0, 1.0)
    below = geo.point(F.lit(-30.0), F.degrees("b"))
    p = _points(spark, d).where((F.col("a") > -1.2) & (F.abs(F.col("b")) > 1e-6) & (F.abs(F.col("b") - 1) > 1e-6) & (F.abs(F.col("p.z")) > 1e-12))
    return p.select("c_custkey", F.round(I.edge_distance(F.col("p"), a, b), 6).alias("distance"), I.simple_crossing(a, b, below, F.col("p")).alias("crosses"), I.ccw(a, b, F.col("p")).alias("side"))


@query(f"""with p as ({_XYZ}) select c_custkey, round(r * acos(greatest(-1, least(1, z))), 6) as gone, round(abs(b), 6) as area, round(a * 6371.0, 4) as km, round(degrees(a) * 1e6)::integer as e6 from p where abs(degrees(a)) < 89.9 and abs(b) < 3.1 and abs(degrees(a) * 1e6 - floor(degrees(a) * 1e6) - 0.5) > 1e-3""")
def sphere_measures(spark, d):
    """Points on the way from the north pole, triangles from the pole to the equator, units of length and angle."""
    pole, p = geo.point(F.lit(90.0), F.lit(0.0)), F.col("p")
    zero, there = geo.point(F.lit(0.0), F.lit(0.0)), geo.point(F.lit(0.0), F.degrees("b"))
    rows = _points(spark, d).where((F.abs(F.degrees("a")) < 89.9) & (F.abs(F.col("b")) < 3.1) & (F.abs(F.degrees("a") * 1e6 - F.floor(F.degrees("a") * 1e6) - 0.5) > 1e-3))
    return rows.select("c_custkey", F.round(I.between_axes(pole, I.edge_point(pole, p, F.col("r"))), 6).alias("gone"), F.round(I.triangle_area(pole, zero, there), 6).alias("area"), F.round(I.radians_to_km(F.col("a")), 4).alias("km"), I.e_degrees(F.degrees("a"), 6).alias("e6"))


# Cells: their ids by a walk down the curve

_FACE = """select c_custkey, x, y, z, case when abs(x) >= abs(y) and abs(x) >= abs(z) then case when x < 0 then 3 else 0 end when abs(y) >= abs(z) then case when y < 0 then 4 else 1 end else case when z < 0 then 5 else 2 end end as f from ({})"""
_UV = """select c_custkey, f, case f when 0 then y / x when 1 then -x / y when 2 then -x / z when 3 then z / x when 4 then z / y else -y / z end as u,
case f when 0 then z / x when 1 then z / y when 2 then -y / z when 3 then y / x when 4 then -x / y else -x / z end as v from ({})"""
_ST = "case when {0} >= 0 then 0.5 * sqrt(1 + 3 * {0}) else 1 - 0.5 * sqrt(1 - 3 * {0}) end"
_CELLS = f"""with recursive fuv as ({_UV.format(_FACE.format(_XYZ))}),
ij as (select c_custkey, f, least(1073741823, floor(({_ST.format('u')}) * 1073741824))::bigint as i, least(1073741823, floor(({_ST.format('v')}) * 1073741824))::bigint as j from fuv),
walk(c_custkey, i, j, k, turn, id) as (select c_custkey, i, j, 29, f % 2, f::hugeint from ij
union all select c_custkey, i, j, k - 1, case p when 0 then xor(turn, 1) when 3 then xor(turn, 3) else turn end, id * 4 + p from (select *, [0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0][turn * 4 + ((i >> k) & 1) * 2 + ((j >> k) & 1) + 1] as p from walk where k >= 0)),
cells as (select c_custkey, (case when id * 2 + 1 >= 9223372036854775808 then id * 2 + 1 - 18446744073709551616 else id * 2 + 1 end)::bigint as cell from walk where k = -1)"""


@query(_CELLS + " select c_custkey, (cell >> 20) as cell from cells")
def geo_cell_from_latlng(spark, d):
    """Cells of level 20 or so: the last bits hang on the last digits of sines."""
    return coordinates(read(spark, d, "customer"), "c_custkey").select("c_custkey", F.shiftright(geo.cell_id("lat", "lng"), 20).alias("cell"))


_AT10 = "((case when cell < 0 then cell + 18446744073709551616::hugeint else cell::hugeint end) // 2199023255552)"


@query(_CELLS + f""" select c_custkey, ((({_AT10} + 3) % (6 * 1048576)) * 2199023255552 + 1099511627776) % 9223372036854775808 as low_bits, ({_AT10} % 4)::integer as place, round(4 * pi() / 6 / 1048576, 15) as area, true as valid from cells""")
def cell_steps(spark, d):
    """Three steps along the curve at level 10, the place among four siblings, the mean area."""
    c = coordinates(read(spark, d, "customer"), "c_custkey").select("c_custkey", geo.parent(geo.cell_id("lat", "lng"), 10).alias("cell"))
    to = geo.advance_wrapped(F.col("cell"), F.lit(3))
    return c.select("c_custkey", to.bitwiseAND(F.lit((1 << 63) - 1)).cast("decimal(38,0)").alias("low_bits"), geo.child_position(F.col("cell"), 10).alias("place"), F.round(geo.average_area(F.lit(10)), 15).alias("area"), (geo.is_valid(F.col("cell")) & ~geo.is_valid(F.col("cell").bitwiseOR(F.shiftrightunsigned(geo.lsb(F.col("cell")), 1)))).alias("valid"))


@query(_CELLS + f""", p as (select distinct n.c_nationkey, {_AT10} // 4096 as spot from cells join customer n using (c_custkey))
select c_nationkey, count(*)::bigint as n, sum(spot)::hugeint % 1000000007 as total from p group by 1""")
def cells_by_nation(spark, d):
    """Distinct cells of level 4 of each nation's customers."""
    c = coordinates(read(spark, d, "customer"), "c_custkey").select("c_nationkey", F.shiftrightunsigned(geo.cell_id("lat", "lng"), 53).alias("at")).distinct()
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), (F.sum(F.col("at").cast("decimal(38,0)")) % 1000000007).alias("total"))


@query(_CELLS + f""", s as (select {_AT10} // 4096 as spot, count(*) as n from cells group by 1) select spot::bigint as spot, n from s""")
def cell_union_holds(spark, d):
    """Points by the cell of a normalised union of all their cells of level 4 that holds them, seen through the union's test."""
    c = coordinates(read(spark, d, "customer"), "c_custkey").select(geo.cell_id("lat", "lng").alias("leaf"))
    by = c.withColumn("cell", geo.parent(F.col("leaf"), 4)).groupBy("cell").agg(F.count("*").alias("n"), *geo_array())
    held = by.where(geo.union_contains(geo.cell_union("some"), F.col("leaf")) & geo.union_intersects(geo.cell_union("some"), F.col("cell")))
    return held.select(F.shiftrightunsigned("cell", 53).alias("spot"), "n")


def geo_array():
    """A leaf of the group, and an array of its cell of level 4."""
    return F.min("leaf").alias("leaf"), F.array(F.min(geo.parent(F.col("leaf"), 4))).alias("some")


@query("select s_suppkey, true as covered, true as few, true as inside, true as around from supplier")
def coverings_hold(spark, d):
    """A covering holds the cap's centre and points of its rim and has eight cells at most; an interior covering lies in the covering; four cells meet
    at a corner, three at a cube's; an expanded union holds the cells around it."""
    # a small table is one split, but coverings take a millisecond a row
    s = coordinates(read(spark, d, "supplier").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "s_suppkey")
    s = s.withColumn("cells", geo.covering("lat", "lng", F.lit(0.05))).withColumn("inner", geo.interior_covering("lat", "lng", F.lit(0.05))).withColumn("leaf", geo.cell_id("lat", "lng"))
    s = s.withColumn("north", geo.cell_id(F.least(F.col("lat") + math.degrees(0.0499), F.lit(90.0)), F.col("lng"))).withColumn("own", geo.parent(F.col("leaf"), 8))
    s = s.withColumn("meet", geo.vertex_neighbours("leaf", F.lit(8))).withColumn("near", geo.neighbours("own")).withColumn("more", geo.expanded(F.array("own"), F.lit(8)))
    covered = geo.union_contains(F.col("cells"), F.col("leaf")) & (geo.union_contains(F.col("cells"), F.col("north")) | (F.col("lat") > 87))
    around = F.array_contains("meet", F.col("own")) & F.size("meet").between(3, 4) & F.forall("near", lambda c: geo.union_contains(F.col("more"), c))
    return s.select("s_suppkey", covered.alias("covered"), (F.size("cells") <= 8).alias("few"), (geo.union_contains_union(F.col("cells"), F.col("inner")) & (F.size("inner") > 0)).alias("inside"), around.alias("around"))


@query("select s_suppkey, true as same, 4::integer as corners from supplier")
def cell_shapes(spark, d):
    """A cell's area is the sum of its children's, its centre's cell is a child of it, its corners lie in cells that meet it."""
    s = coordinates(read(spark, d, "supplier"), "s_suppkey").select("s_suppkey", geo.parent(geo.cell_id("lat", "lng"), 7).alias("cell"))
    s = s.withColumn("area", geo.cell_area("cell")).withColumn("parts", sum((geo.cell_area(geo.child(F.col("cell"), k)) for k in range(1, 4)), geo.cell_area(geo.child(F.col("cell"), 0)))).withColumn("mid", geo.cell_center("cell"))
    back = geo.cell_id(F.degrees(F.asin("mid.z")), F.degrees(F.atan2("mid.y", "mid.x")))
    return s.withColumn("back", back).select("s_suppkey", ((F.abs(F.col("area") / F.col("parts") - 1) < 1e-6) & geo.contains(F.col("cell"), F.col("back"))).alias("same"), F.size(geo.cell_corners("cell")).alias("corners"))


# Polylines, integrals, regions, crossings, wide numbers


@query(f"""select c_custkey, 0.5::double as quarter, round(case when b between 0 and 2 then b / 2 when b < 0 or b > 1 + pi() then case when cos(b) > cos(b - 2) then 0.0 else 1.0 end else 1.0 end, 5) as part, z < 0 as right_side
from ({_XYZ}) where a between -1.2 and 1.2 and abs(b) < 2.9 and abs(z) > 1e-9 and abs(b) > 1e-6 and abs(b - 2) > 1e-6 and b > -1""")
def polyline_points(spark, d):
    """A line along the equator from longitude 0 over 1 to 2 (radians): its quarter, the parts at which it is nearest to points, its right side."""
    at = lambda lng: geo.point(F.lit(0.0), F.lit(math.degrees(lng)))
    line = F.array(at(0.0), at(1.0), at(2.0))
    p = _points(spark, d).where((F.col("a") >= -1.2) & (F.col("a") <= 1.2) & (F.abs("b") < 2.9) & (F.abs("p.z") > 1e-9) & (F.abs("b") > 1e-6) & (F.abs(F.col("b") - 2) > 1e-6) & (F.col("b") > -1))
    q = paths.interpolate(line, F.lit(0.25))
    return p.select("c_custkey", F.round(F.atan2(q["y"], q["x"]), 6).alias("quarter"), F.round(paths.uninterpolate(line, F.col("p")), 5).alias("part"), paths.is_right(line, F.col("p")).alias("right_side"))


@query(f"""with p as (select s_suppkey, {LAT.format('s_suppkey')} as lat, {LNG.format('s_suppkey')} as lng from supplier) select s_suppkey, round(2 * radians(3.0) * (sin(radians(least(84.0, greatest(-84.0, lat)) + 3)) - sin(radians(least(84.0, greatest(-84.0, lat)) - 3))) / 1000, 6) as area,
(case when s_suppkey % 7 = 0 then 30 else greatest(0, least(30, ceil(log2(1.459213746386106 / (0.001 * (s_suppkey % 7)))))) end)::integer as level from p""")
def loop_integral(spark, d):
    """Areas of squares of six degrees by a sum over triangles, to three digits those of rectangles; levels by length."""
    s = coordinates(read(spark, d, "supplier"), "s_suppkey").withColumn("lat", F.greatest(F.lit(-84.0), F.least(F.lit(84.0), F.col("lat"))))
    loop = F.array(*[geo.point(F.col("lat") + 3 * i, F.col("lng") + 3 * j) for i, j in ((-1, -1), (-1, 1), (1, 1), (1, -1))])
    return s.select("s_suppkey", F.round(paths.surface_integral(loop, paths.signed_area) / 1000, 6).alias("area"), paths.min_level(F.col("s_suppkey") % 7 * 0.001, paths.AVG_EDGE).alias("level"))


@query(f"select c_custkey from ({_XYZ}) where (x >= cos(0.8) or (a between 0.1 and 0.9 and b between 1.0 and 2.5)) and not y >= cos(0.4) and abs(x - cos(0.8)) > 1e-9 and abs(y - cos(0.4)) > 1e-9")
def regions(spark, d):
    """A cap or a rectangle, but not another cap."""
    here = lambda lng: geo.point(F.lit(0.0), F.lit(lng))
    box = I.rect(I.interval(0.1, 0.9), I.interval(1.0, 2.5))
    region = (paths.cap_region(here(0.0), 0.8) | paths.rect_region(box)) & ~paths.cap_region(here(90.0), 0.4)
    p = _points(spark, d).where((F.abs(F.col("p.x") - math.cos(0.8)) > 1e-9) & (F.abs(F.col("p.y") - math.cos(0.4)) > 1e-9))
    return p.where(region.holds(F.col("p"))).select("c_custkey")


_S = f"select s_suppkey as k, radians({LAT.format('s_suppkey')}) as a, radians({LNG.format('s_suppkey')}) as b from supplier"
_ENDS = "cos(a) * cos(b) as ax, cos(a) * sin(b) as ay, sin(a) as az, cos(a + {0}) * cos(b + {1}) as bx, cos(a + {0}) * sin(b + {1}) as by_, sin(a + {0}) as bz"


@query(f"""with s as ({_S}), l as (select k as l, {_ENDS.format(0.3, 0.2)} from s), r as (select k as r, cos(a) * cos(b) as cx, cos(a) * sin(b) as cy, sin(a) as cz, cos(a - 0.2) * cos(b + 0.4) as dx, cos(a - 0.2) * sin(b + 0.4) as dy, sin(a - 0.2) as dz from s),
p as (select l, r, -((ay * bz - az * by_) * cx + (az * bx - ax * bz) * cy + (ax * by_ - ay * bx) * cz) as acb, -((cy * dz - cz * dy) * bx + (cz * dx - cx * dz) * by_ + (cx * dy - cy * dx) * bz) as cbd,
((ay * bz - az * by_) * dx + (az * bx - ax * bz) * dy + (ax * by_ - ay * bx) * dz) as bda, ((cy * dz - cz * dy) * ax + (cz * dx - cx * dz) * ay + (cx * dy - cy * dx) * az) as dac from l, r)
select l, r from p where l <> r and acb * cbd > 0 and acb * bda > 0 and acb * dac > 0""")
def edge_crossing_join(spark, d):
    """An edge from each supplier to the north-east and one to the south-east: those that cross."""
    s = coordinates(read(spark, d, "supplier"), "s_suppkey")
    at = lambda i, j: geo.point(F.col("lat") + math.degrees(i), F.col("lng") + math.degrees(j))
    left, right = s.select(F.col("s_suppkey").alias("l"), at(0.0, 0.0).alias("a"), at(0.3, 0.2).alias("b")), s.select(F.col("s_suppkey").alias("r"), at(0.0, 0.0).alias("a"), at(-0.2, 0.4).alias("b"))
    return edges.crossing_edges(left, right).where("l != r")


@query("select o_orderkey, (o_orderkey::hugeint * 18446744073709551616::hugeint + o_custkey) % 1000000007 as rest, o_custkey as low, (o_orderkey::hugeint * 12345678901234567::hugeint + 5) % 1000000007 as product from orders")
def wide_numbers(spark, d):
    o = read(spark, d, "orders")
    w = paths.wide(F.col("o_orderkey"), F.col("o_custkey"))
    product = F.col("o_orderkey").cast("decimal(18,0)") * F.lit(12345678901234567).cast("decimal(18,0)") + 5
    return o.select("o_orderkey", (w % 1000000007).alias("rest"), paths.wide_low(w).alias("low"), (product % 1000000007).alias("product"))
