"""Joins of edges on the sphere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges for which a cell of the grid in space has a side of 1, which shrinks in proportion with more of them, and its bounds.
SIDE_EDGES, LEAST_SIDE, MOST_SIDE = 36_000, 0.05, 0.25
#: Pairs that are tested at a time, and pairs in a batch of the result.
AT_A_TIME, BATCH = 1 << 18, 1 << 16
#: What rounding may add to a place or to a side of a plane.
SLACK = 1e-9
_ENDS = ["ax", "ay", "az", "bx", "by", "bz"]


def cells_of(a: np.ndarray, b: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray]:
    """(edge, cell), sorted and distinct: the cells of a grid in space that each edge between unit vectors may pass through.

    An edge is cut into pieces of half a side at most; a piece lies within the box of its ends, widened by how far an arc leaves its chord.
    """
    whole = np.arctan2(np.linalg.norm(np.cross(a, b), axis=1), (a * b).sum(1))
    n = np.maximum(1, np.ceil(2 * whole / side)).astype(np.int64)
    edge = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)

    def at(part):
        w, s = whole[edge], np.sin(whole[edge])
        s = np.where(s == 0, 1.0, s)[:, None]
        p = np.sin((1 - part) * w)[:, None] / s * a[edge] + np.sin(part * w)[:, None] / s * b[edge]
        return np.where((part == 0)[:, None], a[edge], np.where((part == 1)[:, None], b[edge], p))

    p, q = at(k / n[edge]), at((k + 1) / n[edge])
    bulge = (1 - np.cos(whole / n / 2) + SLACK)[edge, None]
    low, high = (np.floor(x / side).astype(np.int64) + (1 << 10) for x in (np.minimum(p, q) - bulge, np.maximum(p, q) + bulge))
    found = []
    for i in range(int((high - low).max(initial=0)) + 1):
        for j in range(int((high - low)[:, 1].max(initial=0)) + 1):
            for m in range(int((high - low)[:, 2].max(initial=0)) + 1):
                c = low + (i, j, m)
                good = (c <= high).all(1)
                found.append(np.stack([edge[good], (c[good, 0] << 22) + (c[good, 1] << 11) + c[good, 2]]))
    found = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    order = np.lexsort((found[1], found[0]))
    found = found[:, order]
    new = np.append(True, (found[:, 1:] != found[:, :-1]).any(0)) if len(order) else np.zeros(0, bool)
    return found[0, new], found[1, new]


def _dealt(side: float):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                ends = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[2:]], 1)
                edge, cell = cells_of(ends[:, :3], ends[:, 3:], side)
                yield pa.RecordBatch.from_arrays([pa.array(cell), *[c.take(pa.array(edge)) for c in part.columns]], ["cell", *part.schema.names])

    return run


def crossing(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """simple_crossing of rows of edges ab and cd, digit for digit."""
    cross = lambda p, q: (p[:, 1] * q[:, 2] - p[:, 2] * q[:, 1], p[:, 2] * q[:, 0] - p[:, 0] * q[:, 2], p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0])
    dot = lambda n, p: n[0] * p[:, 0] + n[1] * p[:, 1] + n[2] * p[:, 2]
    ab, cd = cross(a, b), cross(c, d)
    acb, cbd, bda, dac = -dot(ab, c), -dot(cd, b), dot(ab, d), dot(cd, a)
    return (acb * cbd > 0) & (acb * bda > 0) & (acb * dac > 0)


def _listed(ends: np.ndarray, side: float) -> np.ndarray:
    """Cells of each edge, a row for each, filled up with -1."""
    edge, cell = cells_of(ends[:, :3], ends[:, 3:], side)
    n = np.bincount(edge, minlength=len(ends))
    out = np.full((len(ends), int(n.max(initial=0))), -1, np.int64)
    out[edge, np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)] = cell
    return out


def pairs(left: np.ndarray, right: np.ndarray, cell: int, side: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of edges of one cell that cross, for which this cell is the least that both may pass through."""
    if not len(left) or not len(right):
        return
    ab, cd = np.cross(left[:, :3], left[:, 3:]), np.cross(right[:, :3], right[:, 3:])
    own, other = _listed(left, side), _listed(right, side)
    wide = min(len(right), 1024)
    high = AT_A_TIME // wide
    for x in range(0, len(left), high):
        n, a, b = ab[x : x + high], left[x : x + high, :3], left[x : x + high, 3:]
        for y in range(0, len(right), wide):
            m, c, d = cd[y : y + wide].T, right[y : y + wide, :3].T, right[y : y + wide, 3:].T
            acb, cbd, bda, dac = -(n @ c), -(b @ m), n @ d, a @ m
            least = np.minimum(np.minimum(acb, cbd), np.minimum(bda, dac)) > -SLACK
            i, j = np.nonzero(least | (np.maximum(np.maximum(acb, cbd), np.maximum(bda, dac)) < SLACK))
            i, j = i + x, j + y
            good = crossing(left[i, :3], left[i, 3:], right[j, :3], right[j, 3:])
            i, j = i[good], j[good]
            for lo in range(0, len(i), 1 << 14):
                p, q = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
                # lists are sorted, so a cell before this one that both have comes first
                again = np.zeros(len(p), bool)
                for k in range(own.shape[1]):
                    before = own[p, k]
                    again |= ((before >= 0) & (before < cell)) & (other[q] == before[:, None]).any(1)
                yield p[~again], q[~again]


def _met(side: float):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        first = rows["first"].to_numpy()
        ends = np.stack([rows[k].to_numpy() for k in _ENDS], 1)
        ids = rows["id"].combine_chunks()
        l, r = (np.flatnonzero(x) for x in (first, ~first))  # noqa: E741
        held, size = [], 0

        def batch():
            i, j = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j))], ["l", "r"])

        for i, j in pairs(ends[l], ends[r], key[0].as_py(), side):
            held.append((l[i], r[j]))
            size += len(i)
            if size >= BATCH:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return run


def crossing_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(l, a, b) and right(r, a, b), ends as unit vectors -> (l, r) of edges that cross inside both; ids are longs.

    Edges meet in the cells of a grid in space that they may pass through, some half a dozen each; within a cell all pairs are tested in blocks of
    AT_A_TIME, and a pair that meets in several cells counts in the least of them. So no candidate is written down or shuffled. The result
    itself grows with the number of edges squared. Edges that are half a circle long have no middle and take no part.
    """
    spark = left.sparkSession
    flat = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.lit(key == "l").alias("first"), *[F.col(f"{v}.{k}").alias(v + k) for v in "ab" for k in "xyz"]).dropna(subset=_ENDS)
    every = flat(left, "l").unionByName(flat(right, "r"))
    side = min(MOST_SIDE, max(LEAST_SIDE, SIDE_EDGES / max(1, left.count())))
    dealt = every.mapInArrow(_dealt(side), "cell long, id long, first boolean, " + ", ".join(f"{k} double" for k in _ENDS))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell")
    return dealt.groupBy("cell").applyInArrow(_met(side), "l long, r long")
