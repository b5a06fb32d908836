import numpy as np
from pyspark.sql import functions as F

from tessera.functions import geo


def points(n, seed=0):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def test_cells():
    p = points(5000)
    ids = geo.ids_of_points(*p.T)
    assert np.abs(geo.centers(ids) - p).max() < 1e-8
    assert (geo.ids_of_points(*geo.centers(ids).T) == ids).mean() > 0.99
    axes = np.concatenate([np.eye(3), -np.eye(3)])
    assert (geo.ids_of_points(*axes.T).view(np.uint64) >> np.uint64(61)).tolist() == list(range(6))


def test_cover_holds_every_point():
    rng = np.random.default_rng(3)
    for axis in points(15, 1):
        angle = float(rng.choice([0.001, 0.05, 0.6, 2.0]))
        (cells,) = geo.cover_caps(axis[None], np.array([angle]))
        near = axis + rng.normal(size=(300, 3)) * angle
        near /= np.linalg.norm(near, axis=1, keepdims=True)
        near = near[np.arccos(np.clip(near @ axis, -1, 1)) <= angle]
        leaves = geo.ids_of_points(*near.T).view(np.uint64).tolist()
        spans = [((c & (1 << 64) - 1) - (c & -c) + 1, (c & (1 << 64) - 1) + (c & -c) - 1) for c in cells]
        assert all(any(a <= x <= b for a, b in spans) for x in leaves)
        assert cells == geo.normalize(cells)


def test_normalize():
    face = 1 << 60
    kids = [face + (2 * k - 3) * (1 << 58) for k in range(4)]
    assert geo.normalize(kids) == [face] and geo.normalize([*kids[:3], kids[0] - 1]) == kids[:3] and geo.normalize([]) == []


def test_expressions(spark):
    df = spark.createDataFrame([(int(x),) for x in geo.ids_of_points(*points(200).T)], "id long")
    df = df.withColumn("p", geo.parent(F.col("id"), 7))
    row = df.select(F.bool_and(geo.level(F.col("id")) == 30).alias("a"), F.bool_and(geo.level(F.col("p")) == 7).alias("b"), F.bool_and(geo.contains(F.col("p"), F.col("id"))).alias("c"), F.bool_and(geo.from_token(geo.token(F.col("p"))) == F.col("p")).alias("d"),
                    F.bool_and(geo.parent(geo.child(F.col("p"), 2), 7) == F.col("p")).alias("e"), F.bool_and(geo.face(F.col("id")).between(0, 5)).alias("f")).first()
    assert all(row)


def test_loops_and_cell_sets():
    from tessera.functions import shapes

    octant = np.eye(3)
    assert abs(shapes.loop_area(octant) - np.pi / 2) < 1e-12
    mid = np.ones(3) / 3**0.5
    assert shapes.loop_contains(octant, mid) and not shapes.loop_contains(octant, -mid) and not shapes.loop_contains(octant, np.array([0.0, -0.6, 0.8]))
    inside = [(p > 0).all() for p in points(500, 7)]
    assert [shapes.loop_contains(octant, p) for p in points(500, 7)] == inside
    r = np.random.default_rng(2)
    for _ in range(30):
        a, b = ([int(c) for c in (geo.ids_of_points(*points(12, int(r.integers(1e6))).T) & -(1 << 56)) | (1 << 56)] for _ in range(2))
        both, either, only = (shapes.combine(a, b, f) for f in (lambda x, y: x and y, lambda x, y: x or y, lambda x, y: x and not y))
        count = lambda cells: sum((c & shapes.ALL) & -(c & shapes.ALL) for c in cells)
        assert count(either) == count(geo.normalize(a)) + count(geo.normalize(b)) - count(both) == count(only) + count(geo.normalize(b))
        assert geo.normalize(only + both) == geo.normalize(a) and geo.normalize(a + b) == either
