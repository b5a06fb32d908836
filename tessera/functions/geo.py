"""Spherical geometry: expressions for angles, caps, rectangles and cell ids; vectorised functions for cells of points and coverings.

A cell id is the BIGINT with the bits of the unsigned 64-bit id. Ids of faces 4 and 5 are negative; `unsigned_order` sorts them right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

EARTH_KM = 6371.0
LEVELS = 30
#: Order of the four children by orientation, and the change of orientation in each.
ORDER = np.array([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]])
TURN = np.array([1, 0, 0, 3])
_PLACE = np.argsort(ORDER, axis=1)


def point(lat: Column, lng: Column) -> Column:
    """Unit vector of degrees."""
    a, b = F.radians(lat), F.radians(lng)
    return F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))


def lat_lng(p: Column) -> Column:
    return F.struct(F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"), F.degrees(F.atan2(p["y"], p["x"])).alias("lng"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Angle in radians."""
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((b - a) / 2), F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    x = s * s + t * t * F.cos(a) * F.cos(b)
    return 2 * F.atan2(F.sqrt(x), F.sqrt(F.greatest(F.lit(0.0), 1 - x)))


def cap_contains(axis: Column, height: Column, p: Column) -> Column:
    dx, dy, dz = (axis[k] - p[k] for k in "xyz")
    return dx * dx + dy * dy + dz * dz <= 2 * height


def cap_height(angle: Column) -> Column:
    return 2 * F.pow(F.sin(angle / 2), 2)


def s1_contains(lo: Column, hi: Column, x: Column) -> Column:
    """Interval on the circle; lo > hi goes through the wrap."""
    return F.when(lo <= hi, (x >= lo) & (x <= hi)).otherwise((x >= lo) | (x <= hi))


def s1_length(lo: Column, hi: Column, turn: float) -> Column:
    return F.when(hi >= lo, hi - lo).otherwise(hi - lo + turn)


def rect_contains(lat: Column, lng: Column, lat_lo, lat_hi, lng_lo, lng_hi) -> Column:
    return lat.between(lat_lo, lat_hi) & s1_contains(F.lit(lng_lo), F.lit(lng_hi), lng)


def unsigned_order(cell: Column) -> Column:
    return cell.bitwiseXOR(F.lit(-(1 << 63)))


def lsb(cell: Column) -> Column:
    return cell.bitwiseAND(-cell)


def face(cell: Column) -> Column:
    return F.shiftrightunsigned(cell, 61).cast("int")


def level(cell: Column) -> Column:
    return F.lit(LEVELS) - F.floor((F.bit_count(lsb(cell) - 1)) / 2).cast("int")


def parent(cell: Column, at: int) -> Column:
    bit = 1 << 2 * (LEVELS - at)
    return cell.bitwiseAND(F.lit(-bit)).bitwiseOR(F.lit(bit))


def child(cell: Column, k: int) -> Column:
    """k from 0 to 3."""
    return cell + F.lit(2 * k - 3) * F.shiftrightunsigned(lsb(cell), 2)


def range_min(cell: Column) -> Column:
    return cell - (lsb(cell) - 1)


def range_max(cell: Column) -> Column:
    return cell + (lsb(cell) - 1)


def contains(cell: Column, other: Column) -> Column:
    x = unsigned_order(other)
    return (x >= unsigned_order(range_min(cell))) & (x <= unsigned_order(range_max(cell)))


def token(cell: Column) -> Column:
    """Hex without the zeros at the end; X for the id 0."""
    return F.when(cell == 0, "X").otherwise(F.rtrim(F.lower(F.lpad(F.hex(cell), 16, "0")), F.lit("0")))


def from_token(c: Column) -> Column:
    bits = F.rpad(c, 16, "0")
    high, low = F.conv(F.substring(bits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(bits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def ids_of_points(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Leaf cells of unit vectors: face, quadratic projection, then thirty steps along the curve."""
    axes = np.stack([x, y, z])
    big = np.abs(axes).argmax(0)
    value = np.take_along_axis(axes, big[None], 0)[0]
    own = np.where(value < 0, big + 3, big)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.select([own == k for k in range(6)], [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.select([own == k for k in range(6)], [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    st = lambda w: np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(w)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(w)))
    i, j = (np.clip(np.floor(st(w) * (1 << LEVELS)).astype(np.int64), 0, (1 << LEVELS) - 1) for w in (u, v))
    return ids_of_ij(own.astype(np.int64), i, j)


def ids_of_ij(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    turn, out = own & 1, own.astype(np.uint64)
    for k in range(LEVELS - 1, -1, -1):
        pos = _PLACE[turn, ((i >> k) & 1) << 1 | (j >> k) & 1]
        out = out << np.uint64(2) | pos.astype(np.uint64)
        turn = turn ^ TURN[pos]
    return ((out << np.uint64(1)) | np.uint64(1)).view(np.int64)


def centers(cells: np.ndarray) -> np.ndarray:
    """Unit vectors of the centres of cells."""
    c = cells.view(np.uint64)
    low = c & (~c + np.uint64(1))
    own, turn = (c >> np.uint64(61)).astype(np.int64), ((c >> np.uint64(61)) & np.uint64(1)).astype(np.int64)
    i, j = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    size = np.full(len(c), 1 << LEVELS, np.int64)
    for k in range(LEVELS):
        bit = np.uint64(2 * (LEVELS - 1 - k) + 1)
        alive = (np.uint64(1) << bit) > low >> np.uint64(0)
        pos = ((c >> bit) & np.uint64(3)).astype(np.int64)
        ij = ORDER[turn, pos]
        half = size >> 1
        i, j = np.where(alive, i + (ij >> 1) * half, i), np.where(alive, j + (ij & 1) * half, j)
        turn, size = np.where(alive, turn ^ TURN[pos], turn), np.where(alive, half, size)
    uv = lambda s: np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) ** 2) / 3)
    u, v = (uv((w + size / 2) / (1 << LEVELS)) for w in (i, j))
    one = np.ones(len(c))
    table = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)]
    p = np.stack([np.select([own == f for f in range(6)], [t[a] for t in table]) for a in range(3)], 1)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


@arrow_udf(LongType())
def cell_id(lat: pa.Array, lng: pa.Array) -> pa.Array:
    """Leaf cell of degrees; null where either is."""
    bad = np.array([a or b for a, b in zip(lat.is_null().to_pylist(), lng.is_null().to_pylist())], bool)
    a, b = (np.radians(np.nan_to_num(x.to_numpy(zero_copy_only=False).astype(float))) for x in (lat, lng))
    return pa.array(ids_of_points(np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)), mask=bad)


def face_ij(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Face, lower i and j, and side in leaves of cells."""
    c = cells.view(np.uint64)
    low = c & (~c + np.uint64(1))
    own, turn = (c >> np.uint64(61)).astype(np.int64), ((c >> np.uint64(61)) & np.uint64(1)).astype(np.int64)
    i, j, size = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.full(len(c), 1 << LEVELS, np.int64)
    for k in range(LEVELS):
        bit = np.uint64(2 * (LEVELS - 1 - k) + 1)
        alive = (np.uint64(1) << bit) > low
        pos = ((c >> bit) & np.uint64(3)).astype(np.int64)
        ij, half = ORDER[turn, pos], size >> 1
        i, j = np.where(alive, i + (ij >> 1) * half, i), np.where(alive, j + (ij & 1) * half, j)
        turn, size = np.where(alive, turn ^ TURN[pos], turn), np.where(alive, half, size)
    return own, i, j, size


def edge_neighbours(cells: np.ndarray) -> np.ndarray:
    """The four cells of the same level that share an edge with each: below, right, above, left in its face's directions."""
    own, i, j, size = face_ij(cells)
    bit = cells & -cells
    uv = lambda t: np.where(t >= 0.5, (4 * t * t - 1) / 3, (1 - 4 * (1 - t) ** 2) / 3)
    out = []
    for di, dj in ((0, -1), (1, 0), (0, 1), (-1, 0)):
        a = i + size // 2 if not di else np.where(di > 0, i + size, i - 1)
        b = j + size // 2 if not dj else np.where(dj > 0, j + size, j - 1)
        top = (1 << LEVELS) - 1
        inside = ids_of_ij(own, np.clip(a, 0, top), np.clip(b, 0, top))
        u, v = uv((a + 0.5) / (1 << LEVELS)), uv((b + 0.5) / (1 << LEVELS))
        one = np.ones(len(u))
        table = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)]
        over = ids_of_points(*[np.select([own == f for f in range(6)], [t[x] for t in table]) for x in range(3)])
        leaf = np.where((a < 0) | (a > top) | (b < 0) | (b > top), over, inside)
        out.append((leaf & -bit) | bit)
    return np.stack(out, 1)


@arrow_udf(ArrayType(LongType()))
def neighbours(cell: pa.Array) -> pa.Array:
    good = np.array([x is not None for x in cell.to_pylist()], bool)
    found = iter(edge_neighbours(np.array([x for x in cell.to_pylist() if x is not None], np.int64)).tolist())
    return pa.array([next(found) if ok else None for ok in good], pa.list_(pa.int64()))


def _sorted(ids) -> list[int]:
    return sorted(set(ids), key=lambda c: c & (1 << 64) - 1)


def normalize(ids: list[int]) -> list[int]:
    """Cells sorted, without contained ones, four siblings merged into their parent."""
    out: list[int] = []
    low = lambda c: c & -c
    for c in _sorted(ids):
        c &= (1 << 64) - 1
        if out and out[-1] - low(out[-1]) + 1 <= c <= out[-1] + low(out[-1]) - 1:
            continue
        while out and c - low(c) + 1 <= out[-1] <= c + low(c) - 1:
            out.pop()
        out.append(c)
        while len(out) >= 4 and low(out[-1]) < 1 << 60:
            bit = low(out[-1])
            up = out[-1] & -(bit << 2) | bit << 2
            if [*out[-4:]] != [up + (2 * k - 3) * bit for k in range(4)]:
                break
            out[-4:] = [up]
    return [c - (1 << 64) if c >> 63 else c for c in out]


@arrow_udf(ArrayType(LongType()))
def cell_union(ids: pa.Array) -> pa.Array:
    return pa.array([None if x is None else normalize([c for c in x if c is not None]) for x in ids.to_pylist()], pa.list_(pa.int64()))


def corners(cells: np.ndarray) -> np.ndarray:
    """Unit vectors of the four corners of cells, counter-clockwise from the lower left in the face's directions: (cells, 4, 3)."""
    own, i, j, size = face_ij(cells)
    side = lambda t: (lambda w: np.where(w >= 0.5, (4 * w * w - 1) / 3, (1 - 4 * (1 - w) ** 2) / 3))(t / (1 << LEVELS))
    u0, u1, v0, v1 = side(i), side(i + size), side(j), side(j + size)
    out = np.stack([face_vectors(own, u, v) for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))], 1)
    return out / np.linalg.norm(out, axis=2, keepdims=True)


def face_vectors(own: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Vectors of face coordinates."""
    one = np.ones(len(u))
    table = [(one, u, v), (-u, one, v), (-u, -v, one), (-one, -v, -u), (v, -one, -u), (v, u, -one)]
    return np.stack([np.select([own == f for f in range(6)], [t[k] for t in table]) for k in range(3)], 1)


def nearest_angle(cells: np.ndarray, axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest angle between each axis and its cell: to an edge or a corner, 0 from inside; to a corner."""
    v = corners(cells)
    at = np.einsum("ckd,cd->ck", v, axis)
    far, near = np.arccos(np.clip(at.min(1), -1, 1)), np.arccos(np.clip(at.max(1), -1, 1))
    inside = np.ones(len(cells), bool)
    for k in range(4):
        a, b = v[:, k], v[:, (k + 1) % 4]
        n = np.cross(a, b)
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        high = np.einsum("cd,cd->c", n, axis)
        inside &= high >= 0
        # the foot of the axis on the edge's circle lies between its ends
        between = (np.einsum("cd,cd->c", np.cross(n, a), axis) >= 0) & (np.einsum("cd,cd->c", np.cross(b, n), axis) >= 0)
        near = np.where(between, np.minimum(near, np.abs(np.arcsin(np.clip(high, -1, 1)))), near)
    return np.where(inside, 0.0, near), far


def cover_caps(axes: np.ndarray, angles: np.ndarray, max_cells: int = 8, min_level: int = 0, max_level: int = LEVELS, interior: bool = False) -> list[list[int]]:
    """Cells that cover caps, or with `interior` cells inside them: all caps go down together, level by level.

    Of cells inside a cap the largest are taken. At each level the cells over a cap's edge are split into those of their children that it meets, the ones with the fewest first, while its
    cells stay within `max_cells`; a level below `min_level` is always split. What isn't split any more belongs to a covering.
    """
    n = len(axes)
    who = np.repeat(np.arange(n), 6)
    cells = np.tile(np.array([(2 * f + 1) << 60 for f in range(6)], np.uint64).view(np.int64), n)
    near, far = nearest_angle(cells, axes[who])
    meets = (near <= angles[who]) & (angles[who] >= 0)
    who, cells, far = who[meets], cells[meets], far[meets]
    done_who, done, held = [], [], np.zeros(n, np.int64)
    for depth in range(LEVELS + 1):
        inside = (far <= angles[who]) & (angles[who] <= np.pi / 2) & (depth >= min_level)
        last = inside | (depth >= max_level)
        keep = last & (inside | (not interior))
        done_who.append(who[keep])
        done.append(cells[keep])
        held += np.bincount(who[keep], minlength=n)
        # inside a cap the largest cells count, so one that has max_cells of them needs no smaller ones
        open_ = ~last & (held[who] < max_cells) if interior else ~last
        who, cells = who[open_], cells[open_]
        if not len(who) or depth == max_level:
            break
        bit = (cells & -cells) >> 2 & ((1 << 62) - 1)
        parts = cells[:, None] + np.array([-3, -1, 1, 3]) * bit[:, None]
        from_ = np.repeat(np.arange(len(cells)), 4)
        near, far = nearest_angle(parts.ravel(), axes[who[from_]])
        meets = near <= angles[who[from_]]
        count = np.bincount(from_[meets], minlength=len(cells))
        # in each cap the cells with the fewest such children first, as long as there is room
        order = np.lexsort((cells, count, who))
        first = np.append(True, who[order][1:] != who[order][:-1]) if len(order) else np.zeros(0, bool)
        more = np.cumsum(count[order] - 1)
        start = np.flatnonzero(first)
        more -= np.repeat((more - (count[order] - 1))[start], np.diff(np.append(start, len(order))))
        total = held[who[order]] + np.bincount(who, minlength=n)[who[order]]
        split = np.zeros(len(cells), bool)
        split[order] = (total + more <= (4 * max_cells if interior else max_cells)) | (depth < min_level)
        if not interior:
            done_who.append(who[~split])
            done.append(cells[~split])
            held += np.bincount(who[~split], minlength=n)
        going = meets & split[from_]
        who, cells, far = who[from_][going], parts.ravel()[going], far[going]
    who, cells = np.concatenate(done_who), np.concatenate(done)
    order = np.argsort(who, kind="stable")
    ends = np.searchsorted(who[order], np.arange(n + 1))
    cells = cells[order].tolist()
    most = max_cells if interior else len(cells)
    return [normalize(sorted(cells[a:b], key=lambda c: -(c & -c & (1 << 64) - 1))[:most]) for a, b in zip(ends[:-1], ends[1:])]


def _axes(lat: pa.Array, lng: pa.Array) -> np.ndarray:
    a, b = (np.radians(np.nan_to_num(x.to_numpy(zero_copy_only=False).astype(float))) for x in (lat, lng))
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)


def _coverings(interior: bool, max_cells: int, min_level: int, max_level: int):
    @arrow_udf(ArrayType(LongType()))
    def covered(lat: pa.Array, lng: pa.Array, angle: pa.Array) -> pa.Array:
        known = np.array(pa.compute.and_(pa.compute.and_(lat.is_valid(), lng.is_valid()), angle.is_valid()).to_pylist(), bool)
        r = np.where(known, np.nan_to_num(angle.to_numpy(zero_copy_only=False).astype(float)), -1.0)
        found = cover_caps(_axes(lat, lng), r, max_cells, min_level, max_level, interior)
        return pa.array([x if ok else None for x, ok in zip(found, known)], pa.list_(pa.int64()))

    return covered


def covering(lat, lng, angle, max_cells: int = 8, min_level: int = 0, max_level: int = LEVELS) -> Column:
    """Cells that cover a cap about degrees with an angle in radians; null where any is, none for a negative angle."""
    return _coverings(False, max_cells, min_level, max_level)(lat, lng, angle)


def interior_covering(lat, lng, angle, max_cells: int = 8, min_level: int = 0, max_level: int = 20) -> Column:
    """Cells that lie inside a cap, as large as there are."""
    return _coverings(True, max_cells, min_level, max_level)(lat, lng, angle)


#: Pairs of points and caps that are tested at a time, and the least side of a cell of the grid in space.
PAIRS, LEAST_SIDE = 1 << 19, 0.02


def _cubes(low: np.ndarray, high: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells of a grid in space that touch boxes, and the unit sphere."""
    first, last = (np.floor(x / side).astype(np.int64) for x in (low, high))
    found = []
    for step in np.ndindex(*((last - first).max(0) + 1).tolist() if len(first) else (0, 0, 0)):
        c = first + step
        near, far = (np.square(f(np.abs(c * side), np.abs((c + 1) * side))).sum(1) for f in (np.minimum, np.maximum))
        row = np.flatnonzero((c <= last).all(1) & (near <= 1 + 1e-9) & (far >= 1 - 1e-9))
        found.append(np.stack([row, _cube(c[row])]))
    return tuple(np.concatenate(found, 1)) if found else (np.zeros(0, np.int64),) * 2


def _cube(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] + (1 << 10) << 22) + (c[:, 1] + (1 << 10) << 11) + c[:, 2] + (1 << 10)


def _in_cells(side: float):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                axes, angle = _axes(part.column(2), part.column(3)), part.column(4).to_numpy(zero_copy_only=False)
                is_point = np.isnan(angle)
                for rows in (np.flatnonzero(is_point), np.flatnonzero(~is_point)):
                    # a cap lies within a chord of its axis
                    reach = np.where(is_point[rows], 0.0, 2 * np.sin(np.minimum(np.nan_to_num(angle[rows]), np.pi) / 2) + 1e-9)[:, None]
                    cell = (rows, _cube(np.floor(axes[rows] / side).astype(np.int64))) if len(rows) and is_point[rows[0]] else _cubes(axes[rows] - reach, axes[rows] + reach, side)
                    taken = rows if len(rows) and is_point[rows[0]] else rows[cell[0]]
                    if len(taken):
                        yield pa.RecordBatch.from_arrays([pa.array(cell[1]), *[c.take(pa.array(taken)) for c in part.columns]], ["cell", *part.schema.names])

    return run


def _within(lat: np.ndarray, lng: np.ndarray, lat2: np.ndarray, lng2: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """haversine of rows, against an angle."""
    a, b = np.radians(lat), np.radians(lat2)
    s, t = np.sin((b - a) / 2), np.sin((np.radians(lng2) - np.radians(lng)) / 2)
    x = s * s + t * t * np.cos(a) * np.cos(b)
    return 2 * np.arctan2(np.sqrt(x), np.sqrt(np.maximum(0.0, 1 - x))) <= angle


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches)).combine_chunks()
    lat, lng, angle = (rows[k].to_numpy() for k in ("lat", "lng", "angle"))
    p, c = np.flatnonzero(np.isnan(angle)), np.flatnonzero(~np.isnan(angle))
    if not len(p) or not len(c):
        return
    axes, ids, caps = _axes(rows["lat"], rows["lng"]), rows["id"].combine_chunks(), rows["cap"].combine_chunks()
    most = np.cos(np.minimum(angle[c], np.pi))
    wide = min(len(c), 1024)
    high = PAIRS // wide
    for x in range(0, len(p), high):
        for y in range(0, len(c), wide):
            at = axes[p[x : x + high]] @ axes[c[y : y + wide]].T - most[y : y + wide]
            i, j = np.nonzero(at >= -1e-14)
            sure = at[i, j] > 1e-14
            i, j = p[x + i], c[y + j]
            ask = np.flatnonzero(~sure)
            sure[ask] = _within(lat[i[ask]], lng[i[ask]], lat[j[ask]], lng[j[ask]], angle[j[ask]])
            if sure.any():
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[sure])), caps.take(pa.array(j[sure]))], ["id", "cap"])


def points_in_caps(points, caps):
    """points(id, lat, lng) and caps(cap, lat, lng, angle) -> (id, cap), a row for each point in each cap. A point lies in one cell of a grid in space, caps go to
    the cells that they may touch, some dozens at most if their angles are alike. In a cell all pairs are tested in blocks of PAIRS, those at a cap's rim exactly. The
    cells' side comes from the mean and the largest angle."""
    spark = caps.sparkSession
    caps = caps.where("angle >= 0").dropna(subset=["lat", "lng", "angle"])
    mean, most = caps.agg(F.avg(F.least("angle", F.lit(np.pi))), F.max(F.least("angle", F.lit(np.pi)))).first()
    side = max(LEAST_SIDE, (mean or 0.0) / 2, (most or 0.0) / 8)
    kind, cap = points.schema["id"].dataType.simpleString(), caps.schema["cap"].dataType.simpleString()
    double = [F.col(k).cast("double").alias(k) for k in ("lat", "lng")]
    every = points.dropna(subset=["lat", "lng"]).select("id", F.lit(None).cast(cap).alias("cap"), *double, F.lit(float("nan")).alias("angle"))
    every = every.unionByName(caps.select(F.lit(None).cast(kind).alias("id"), "cap", *double, F.col("angle").cast("double")))
    dealt = every.mapInArrow(_in_cells(side), f"cell long, id {kind}, cap {cap}, lat double, lng double, angle double")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell")
    return dealt.groupBy("cell").applyInArrow(_matched, f"id {kind}, cap {cap}")


# More of cells


def is_valid(cell: Column) -> Column:
    """A face from 0 to 5, and the lowest bit at an even place."""
    return (F.shiftrightunsigned(cell, 61) < 6) & (lsb(cell).bitwiseAND(F.lit(0x1555555555555555)) != 0)


def advance(cell: Column, steps: Column) -> Column:
    """The cell so many places further along the curve at its level, kept between the first and the one behind the last."""
    shift = 2 * (LEVELS - level(cell)) + 1
    at = F.call_function("shiftrightunsigned", cell, shift).cast("long")
    count = F.call_function("shiftleft", F.lit(6).cast("long"), 2 * level(cell))
    to = F.greatest(F.lit(0).cast("long"), F.least(count, at + steps))
    return F.call_function("shiftleft", to, shift).bitwiseOR(lsb(cell))


def advance_wrapped(cell: Column, steps: Column) -> Column:
    """As advance, but behind the last cell comes the first."""
    shift = 2 * (LEVELS - level(cell)) + 1
    count = F.call_function("shiftleft", F.lit(6).cast("long"), 2 * level(cell))
    to = F.pmod(F.call_function("shiftrightunsigned", cell, shift).cast("long") + steps, count)
    return F.call_function("shiftleft", to, shift).bitwiseOR(lsb(cell))


def child_position(cell: Column, at: int) -> Column:
    """Which of its four siblings the ancestor at a level is."""
    return F.shiftrightunsigned(cell, 2 * (LEVELS - at) + 1).bitwiseAND(F.lit(3)).cast("int")


def child_begin(cell: Column) -> Column:
    return child(cell, 0)


def child_end(cell: Column) -> Column:
    """Behind the last child."""
    return child(cell, 3) + F.shiftrightunsigned(lsb(cell), 1)


def average_area(at: Column) -> Column:
    """Mean area in steradians of the cells of a level."""
    return 4 * np.pi / 6 / F.pow(F.lit(4.0), at)


def union_contains(cells: Column, cell: Column) -> Column:
    """Whether a set of cells that don't overlap holds a cell."""
    return F.exists(cells, lambda c: contains(c, cell))


def union_intersects(cells: Column, cell: Column) -> Column:
    return F.exists(cells, lambda c: contains(c, cell) | contains(cell, c))


def unions_intersect(a: Column, b: Column) -> Column:
    return F.exists(a, lambda c: union_intersects(b, c))


def union_contains_union(a: Column, b: Column) -> Column:
    return F.forall(b, lambda c: union_contains(a, c))


def _points(column: pa.Array) -> np.ndarray:
    return np.array([(p["x"], p["y"], p["z"]) for p in column.to_pylist()], float).reshape(-1, 3)


POINT = StructType().add("x", DoubleType()).add("y", DoubleType()).add("z", DoubleType())


@arrow_udf(POINT)
def cell_center(cell: pa.Array) -> pa.Array:
    """Unit vector of the centre."""
    p = centers(cell.fill_null(1 << 60).to_numpy(zero_copy_only=False).astype(np.int64))
    return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(3)], ["x", "y", "z"], mask=cell.is_null())


@arrow_udf(ArrayType(POINT))
def cell_corners(cell: pa.Array) -> pa.Array:
    """The four corners as unit vectors, counter-clockwise."""
    known = [x is not None for x in cell.to_pylist()]
    v = corners(cell.fill_null(1 << 60).to_numpy(zero_copy_only=False).astype(np.int64))
    return pa.array([[dict(zip("xyz", p)) for p in four] if ok else None for four, ok in zip(v.tolist(), known)], pa.list_(pa.struct([(k, pa.float64()) for k in "xyz"])))


@arrow_udf(DoubleType())
def cell_area(cell: pa.Array) -> pa.Array:
    """Area in steradians: two triangles."""
    v = corners(cell.fill_null(1 << 60).to_numpy(zero_copy_only=False).astype(np.int64))
    return pa.array(triangles(v[:, 0], v[:, 1], v[:, 2]) + triangles(v[:, 0], v[:, 2], v[:, 3]), mask=np.array(cell.is_null().to_pylist(), bool))


def triangles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Areas of triangles on the sphere."""
    up = np.abs(np.einsum("ij,ij->i", a, np.cross(b, c)))
    down = 1 + sum(np.einsum("ij,ij->i", x, y) for x, y in ((a, b), (b, c), (c, a)))
    return 2 * np.arctan2(up, down)


@arrow_udf(ArrayType(LongType()))
def vertex_neighbours(cell: pa.Array, at: pa.Array) -> pa.Array:
    """The cells of a level that meet at the corner of that level's grid nearest to the cell's centre: four, or three at a corner of the cube."""
    out = []
    known = [c is not None and n is not None for c, n in zip(cell.to_pylist(), at.to_pylist())]
    cells = cell.fill_null(1 << 60).to_numpy(zero_copy_only=False).astype(np.int64)
    levels = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    own, i, j, size = face_ij(cells)
    i, j = i + size // 2, j + size // 2
    width = np.int64(1) << (LEVELS - levels)
    # the nearest corner of the grid, and one leaf on each side of it
    x, y = ((v + width // 2) // width * width for v in (i, j))
    low = np.int64(1) << (2 * (LEVELS - levels))
    found = []
    for dx, dy in ((-1, -1), (0, -1), (0, 0), (-1, 0)):
        leaf = leaves_over_edges(own, x + dx, y + dy)
        found.append((leaf & -low) | low)
    for row, ok in zip(np.stack(found, 1).tolist(), known):
        out.append(_sorted(row) if ok else None)
    return pa.array(out, pa.list_(pa.int64()))


def leaves_over_edges(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Leaf cells at places that may lie one leaf outside their face."""
    top = (1 << LEVELS) - 1
    uv = lambda t: np.where(t >= 0.5, (4 * t * t - 1) / 3, (1 - 4 * (1 - t) ** 2) / 3)
    p = face_vectors(own, uv((i + 0.5) / (1 << LEVELS)), uv((j + 0.5) / (1 << LEVELS)))
    out = (i < 0) | (i > top) | (j < 0) | (j > top)
    return np.where(out, ids_of_points(*p.T), ids_of_ij(own, np.clip(i, 0, top), np.clip(j, 0, top)))


@arrow_udf(ArrayType(LongType()))
def denormalized(cells: pa.Array, min_level: pa.Array, step: pa.Array) -> pa.Array:
    """Cells of a union as ones of a least level, whose levels beyond that are multiples of `step` further down."""
    out = []
    for ids, low, mod in zip(cells.to_pylist(), min_level.to_pylist(), step.to_pylist()):
        if ids is None:
            out.append(None)
            continue
        own = []
        for c in ids:
            u = c & (1 << 64) - 1
            at = LEVELS - ((u & -u).bit_length() - 1) // 2
            to = max(at, low)
            to = min(LEVELS, to + -(to - low) % mod)
            bit = 1 << 2 * (LEVELS - to)
            first = u - (u & -u) + bit
            own += [x - (1 << 64) if x >> 63 else x for x in range(first, u + (u & -u), 2 * bit)]
        out.append(own)
    return pa.array(out, pa.list_(pa.int64()))


@arrow_udf(ArrayType(LongType()))
def expanded(cells: pa.Array, at: pa.Array) -> pa.Array:
    """A union with all cells of a level that touch it, its own smaller cells taken up to that level."""
    out, rows = [], []
    for ids, n in zip(cells.to_pylist(), at.to_pylist()):
        if ids is None:
            rows.append(None)
            continue
        bit, own = 1 << 2 * (LEVELS - n), set()
        for c in ids:
            u = c & (1 << 64) - 1
            if u & -u < bit:
                u = u & -bit | bit
            own.add(u)
        rows.append((own, bit))
    border = iter(around([(u, bit) for own, bit in filter(None, rows) for u in own]))
    for row in rows:
        out.append(None if row is None else normalize([x - (1 << 64) if x >> 63 else x for x in row[0]] + [x for _ in row[0] for x in next(border)]))
    return pa.array(out, pa.list_(pa.int64()))


def around(cells: list[tuple[int, int]]) -> list[list[int]]:
    """For (cell, bit) the cells with the lowest bit `bit` that share a corner or an edge with a cell from outside; those of one size are done together."""
    out: list[list[int]] = [[]] * len(cells)
    u, bits = (np.array(x, np.uint64).view(np.int64) for x in zip(*cells)) if cells else (np.zeros(0, np.int64),) * 2
    own, i, j, size = face_ij(u)
    for bit, side in set(zip(bits.tolist(), size.tolist())):
        width = 1 << (bit.bit_length() - 1) // 2
        places = [(k, m) for k in range(-width, side + width, width) for m in (-width, side)] + [(m, k) for k in range(0, side, width) for m in (-width, side)]
        x, y = (np.array(v, np.int64) for v in zip(*places))
        every, top = np.flatnonzero((bits == bit) & (size == side)), 1 << LEVELS
        for lo in range(0, len(every), max(1, (1 << 16) // len(x))):
            rows = every[lo : lo + max(1, (1 << 16) // len(x))]
            # a place outside the face is looked for one leaf over its edge, as far along it
            a, b = (np.clip(v + width // 2, -1, top).ravel() for v in (i[rows, None] + x, j[rows, None] + y))
            leaf = leaves_over_edges(np.repeat(own[rows], len(x)), a, b).reshape(len(rows), -1)
            for row, found in zip(rows.tolist(), ((leaf & -bit) | bit).tolist()):
                out[row] = sorted(set(found))
    return out
