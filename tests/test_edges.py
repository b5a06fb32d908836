"""The join of crossing edges against all pairs tested."""

import numpy as np

from tessera.operators import edges


def made(seed, n):
    """Edges of all lengths, some from one point, some equal."""
    r = np.random.default_rng(seed)
    a = r.normal(size=(n, 3))
    a[: n // 10] = a[0]
    b = a / np.linalg.norm(a, axis=1, keepdims=True) + r.normal(size=(n, 3)) * 10 ** r.uniform(-2, 1, (n, 1))
    b[-3:], a[-3:] = b[0], a[0]
    return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)], 1)


def test_crossing_edges_are_those_of_all_pairs(spark):
    left, right = made(1, 300), made(2, 300)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300), indexing="ij"))
    good = edges.crossing(left[i, :3], left[i, 3:], right[j, :3], right[j, 3:])
    want = sorted(zip(i[good].tolist(), j[good].tolist()))
    frame = lambda x, key: spark.createDataFrame([(k, tuple(v[:3]), tuple(v[3:])) for k, v in enumerate(x.tolist())], f"{key} long, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>")
    found = edges.crossing_edges(frame(left, "l"), frame(right, "r"))
    assert sorted((x.l, x.r) for x in found.collect()) == want and len(want) > 1000
    # candidates aren't joined and made distinct row by row: no more is shuffled than the edges by cell
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_come_from_one_cell():
    """Whatever the side of the cells and the size of the blocks."""
    left, right = made(3, 200), made(4, 200)
    for side in (0.05, 0.25):
        own, other = (dict() for _ in range(2))
        for held, x in ((own, left), (other, right)):
            for e, c in zip(*(v.tolist() for v in edges.cells_of(x[:, :3], x[:, 3:], side))):
                held.setdefault(c, []).append(e)
        got = [(own[c][i], other[c][j]) for c in own.keys() & other.keys() for p in edges.pairs(left[own[c]], right[other[c]], c, side) for i, j in zip(*(v.tolist() for v in p))]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(200), indexing="ij"))
        good = edges.crossing(left[i, :3], left[i, 3:], right[j, :3], right[j, 3:])
        assert sorted(got) == sorted(zip(i[good].tolist(), j[good].tolist()))
