"""The join of points and caps against all pairs."""

import math

import numpy as np

from tessera.functions import geo


def test_points_in_caps_are_those_of_all_pairs(spark):
    """At poles, over the wrap, for caps of all sizes, with nulls; ids of any type."""
    r = np.random.default_rng(5)
    lat, lng = np.degrees(np.arcsin(r.uniform(-1, 1, 400))), r.uniform(-180, 180, 400)
    lat[:5], lng[5:9], lat[9:200] = [90, -90, 90, -90, 0], [180, -180, 0, 90], 90 - r.uniform(0, 3, 191)
    points = [(f"p{k}", float(lat[k]), float(lng[k])) for k in range(400)]
    angle = np.concatenate((10 ** r.uniform(-4, 0.4, 290), [0.0, math.pi, 4.0, 1e-9, -1.0, 0.3, 0.3, 0.3, 3.1, 0.0]))
    at = r.integers(0, 400, 300)
    caps = [(k, float(lat[at[k]]), float(lng[at[k]]), float(angle[k])) for k in range(300)]
    want = {(f"p{i}", k) for k in range(300) for i in np.flatnonzero(geo._within(lat, lng, lat[at[k]], lng[at[k]], angle[k])).tolist()}
    frames = lambda p, c: (spark.createDataFrame(p, "id string, lat double, lng double"), spark.createDataFrame(c, "cap int, lat double, lng double, angle double"))
    found = geo.points_in_caps(*frames(points + [("n", None, 0.0)], caps + [(900, None, 0.0, 0.1), (901, 0.0, 0.0, None)]))
    rows = [(x.id, x.cap) for x in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 3000
    # candidates are tested within their cell: no join makes rows of them
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    small = [x for x in caps if x[3] < 0.02]
    assert {(x.id, x.cap) for x in geo.points_in_caps(*frames(points, small)).collect()} == {x for x in want if x[1] in {c[0] for c in small}}
    assert geo.points_in_caps(*frames(points, [])).collect() == [] == geo.points_in_caps(*frames([], caps)).collect()
