"""Exact top-k by inner product over a pivot-distance index with triangle-inequality bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Pivots, vectors from which they are chosen (least hash of the id), rows of the index and of queries in a block.
PIVOTS, SAMPLE, BLOCK, ASKED = 32, 2_000, 1024, 256
#: Queries: ids divisible by this; neighbours of each.
EVERY, TOP = 50, 5
SCALE = 256
INDEXED = "pivot int, dist double, vec_id long, q array<double>"
TYPES = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
PACKED = "block long, pivot int, low double, high double, n int, dims int, ids binary, dists binary, vectors binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q): floor(SCALE * x) of each component; vectors that are null or have null or non-finite components take no part."""
    big = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), big.alias("q"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of equal length; shorter vectors are filled with zeros, which leaves inner products as they are over the common part."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    flat = flat[ends[0] : ends[-1]]
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    for k, (a, n) in enumerate(zip(ends[:-1] - ends[0], sizes)):
        out[k, :n] = flat[a : a + n]
    return out


class Space:
    """Inner products as distances: a vector x gets one more component, sqrt(M - |x|^2), with M the greatest squared length; queries get 0
    there. Then |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest vectors are those of the greatest inner product."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most

    def lifted(self, x: np.ndarray, asked: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if asked else np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))
        return np.concatenate((x, last[:, None]), 1)

    def distances(self, x: np.ndarray, asked: bool = False) -> np.ndarray:
        y = self.lifted(x, asked)
        square = (y * y).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * y @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def choose(sample: np.ndarray, most: float) -> Space:
    """Pivots far from each other: each is the sample vector that is furthest from those before."""
    space = Space(np.zeros((0, sample.shape[1] + 1)), most)
    y = space.lifted(sample)
    near, picked = ((y - y[0]) ** 2).sum(1), [0]
    while len(picked) < min(PIVOTS, len(y)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((y - y[picked[-1]]) ** 2).sum(1))
    return Space(y[picked], most)


def _packed(size: int, dims: int):
    def packed(batches):
        part, number, held = TaskContext.get().partitionId(), 0, None

        def emit(pivot, dist, ids, x):
            nonlocal number
            number += 1
            row = (part << 32) | number, int(pivot[0]), float(dist.min()), float(dist.max()), len(ids), dims, ids.tobytes(), dist.tobytes(), np.ascontiguousarray(x).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            own = [batch.column(k).to_numpy() for k in range(3)] + [matrix(batch.column(3), dims)]
            held = own if held is None else [np.concatenate((a, b)) for a, b in zip(held, own)]
            while len(held[0]):
                n = int(np.searchsorted(held[0], held[0][0], side="right"))
                if n < size and n == len(held[0]):
                    break  # more rows of the pivot may follow
                k = min(n, size)
                yield emit(*(h[:k] for h in held))
                held = [h[k:] for h in held]
        while held is not None and len(held[0]):
            k = min(int(np.searchsorted(held[0], held[0][0], side="right")), size)
            yield emit(*(h[:k] for h in held))
            held = [h[k:] for h in held]

    return packed


def unpack(row, prefix: str):
    dims = int(row[prefix + "dims"])
    ids = np.frombuffer(row[prefix + "ids"], np.int64)
    return ids, np.frombuffer(row[prefix + "dists"], np.float64), np.frombuffer(row[prefix + "vectors"], np.float64).reshape(len(ids), dims)


def best_of(asked: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int):
    """(query, vec_id, score) of each query's best among these, its own row left out."""
    out = []
    score = np.where(ids[None] == asked[:, None], -np.inf, score)
    k = min(top, len(ids))
    floor = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if k else np.zeros(len(asked))
    for q, row, low in zip(asked.tolist(), score, floor):
        at = np.flatnonzero(row >= low)
        at = at[np.lexsort((ids[at], -row[at]))][:top]
        out += [(q, int(ids[i]), int(row[i])) for i in at.tolist() if row[i] > -np.inf]
    return out


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """Exact neighbours of the rows of vectors(vec_id, embedding) whose id is divisible by `every`: query_id, rank, vec_id, score.

    Score: inner product of the quantised vectors; ties go to the smaller id. Vectors that are null, or have null or non-finite components,
    and rows without an id take no part. A query has all others if they are fewer. Rows that share an id are one query, by the least of their
    vectors; as candidates they count each, but never for a query of their own id. Of vectors of unequal length the common part counts. Empty
    table: no rows. Other columns are ignored.

    The index deals every vector to its nearest pivot and sorts by distance, over range partitions, so a pivot or a distance with many
    vectors lies in many blocks. A query first takes the best of its own block; the bound that gives (a distance r) leaves of each pivot the
    annulus from d - r to d + r, d being the query's distance from the pivot. Queries meet, in blocks, the index blocks that reach into it.
    """
    spark = vectors.sparkSession
    own = quantised(vectors)
    size = own.agg(F.max(F.size("q")).alias("dims"), F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    if not size.dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = int(size.dims)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    first = np.zeros((len(sample), dims))
    for k, r in enumerate(sample):
        first[k, : len(r.q)] = r.q
    space = choose(first, float(size.most))

    def indexed(batches):
        for b in batches:
            d = space.distances(matrix(b.column(1), dims))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), b.column(0), b.column(1)], ["pivot", "dist", "vec_id", "q"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["pivot", "dist", "vec_id"]
    placed = cut(own.mapInArrow(indexed, INDEXED))
    index = cut(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_packed(BLOCK, dims), PACKED))

    def seeded(batches):
        """Each block's queries with the best that their own block has."""
        for b in batches:
            for row in b.to_pylist():
                ids, _, x = unpack(row, "")
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    bound = {}
                    for q, _, s in best_of(ids[at], ids, x[at] @ x.T, top):
                        bound.setdefault(q, []).append(s)
                    low = np.array([bound.get(q, [])[-1] if len(bound.get(q, [])) == top else -np.inf for q in ids[at].tolist()], float)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["pivot"], np.int32)), pa.array(low), pa.array(ids[at]), pa.array([v for v in x[at]], pa.list_(pa.float64()))], ["pivot", "dist", "vec_id", "q"])

    # `dist` carries the score that a query has reached; of rows with one id the least vector asks
    seeds = index.mapInArrow(seeded, INDEXED).groupBy("vec_id").agg(F.min(F.struct("q", (-F.col("dist")).alias("far"), "pivot")).alias("s"))
    seeds = seeds.select("s.pivot", (-F.col("s.far")).alias("dist"), "vec_id", "s.q")
    asked = seeds.sortWithinPartitions("pivot", "vec_id").mapInArrow(_packed(ASKED, dims), PACKED)
    asked = cut(asked.withColumn("block", F.monotonically_increasing_id()))

    def rings(batches):
        """For each block of queries and pivot the distances that its queries can still need."""
        for b in batches:
            for row in b.to_pylist():
                _, low, x = unpack(row, "")
                square = (x * x).sum(1) + space.most
                reach = np.sqrt(np.maximum(square - 2 * low, 0)) * (1 + 1e-9) + 1e-6
                d = space.distances(x, True)
                a, z = (d - reach[:, None]).min(0), (d + reach[:, None]).max(0)
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["block"], np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(a), pa.array(z)], ["asked", "pivot", "a", "z"])

    ring = asked.mapInArrow(rings, "asked long, pivot int, a double, z double")
    names = index.select("block", "pivot", "low", "high")
    pairs = cut(names.join(ring, "pivot").where((F.col("high") >= F.col("a")) & (F.col("low") <= F.col("z"))).select("block", "asked"))
    left = index.select([F.col(c).alias("i_" + c) for c in index.columns])
    right = asked.select([F.col(c).alias("a_" + c) for c in asked.columns])
    met = pairs.join(right, F.col("asked") == F.col("a_block")).join(left, F.col("block") == F.col("i_block"))
    met = met.select("i_pivot", "i_dims", "i_ids", "i_dists", "i_vectors", "a_dims", "a_ids", "a_dists", "a_vectors")

    def compared(batches):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in b.schema.names}
                ids, dist, x = unpack(row, "i_")
                q_ids, low, q = unpack(row, "a_")
                reach = np.sqrt(np.maximum((q * q).sum(1) + space.most - 2 * low, 0)) * (1 + 1e-9) + 1e-6
                d = space.distances(q, True)[:, row["i_pivot"]]
                need = (d - reach <= dist[-1]) & (d + reach >= dist[0])
                if not need.any():
                    continue
                lo, hi = np.searchsorted(dist, (d - reach)[need].min()), np.searchsorted(dist, (d + reach)[need].max(), side="right")
                if lo < hi:
                    found = best_of(q_ids[need], ids[lo:hi], q[need] @ x[lo:hi].T, top)
                    bound = dict(zip(q_ids.tolist(), low.tolist()))
                    out += [f for f in found if f[2] >= bound[f[0]]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(compared, FOUND)
    # Spark keeps the best of each task before it shuffles, since only low ranks are asked for
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
