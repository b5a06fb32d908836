"""Places on polylines, many rows at a time."""

import numpy as np
import pyarrow as pa

from tessera.functions import paths


def test_rows_are_placed_together(monkeypatch):
    """Lines of one length are placed by one call, whatever the number of rows, and as each alone."""
    r = np.random.default_rng(6)
    kind = pa.struct([(k, pa.float64()) for k in "xyz"])
    unit = lambda n: [dict(zip("xyz", (v / np.linalg.norm(v)).tolist())) for v in r.normal(size=(n, 3))]
    lines = pa.array([unit(2 + k % 3) for k in range(600)] + [None, [], unit(1), unit(3)], pa.list_(kind))
    points = pa.array(unit(603) + [None], kind)
    parts = pa.array(r.uniform(-0.2, 1.2, 604))
    calls, plain = [], paths._placed
    monkeypatch.setattr(paths, "_placed", lambda v, p: calls.append(len(v)) or plain(v, p))
    got = paths.place.func(lines, points).to_pylist()
    assert sorted(calls) == [1, 200, 200, 200]
    between = paths.interpolate.func(lines, parts).to_pylist()
    for k in range(604):
        assert got[k] == paths.place.func(lines.slice(k, 1), points.slice(k, 1)).to_pylist()[0]
        assert between[k] == paths.interpolate.func(lines.slice(k, 1), parts.slice(k, 1)).to_pylist()[0]
    assert got[600:602] == [None, None] and got[602]["right"] is None and got[603] is None and between[600:602] == [None, None]
    # the point at the part where a line is nearest is the nearest point
    back = paths.interpolate.func(lines, pa.array([None if x is None else x["part"] for x in got], pa.float64())).to_pylist()
    assert all(abs(a["point"][c] - b[c]) < 1e-7 for a, b in zip(got[:600], back) for c in "xyz")
