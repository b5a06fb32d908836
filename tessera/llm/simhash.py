"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a self-join of their binary trie."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from .common import as_bytes, cut
from .components import connected

#: Bits by which two linked fingerprints may differ.
MAX_BITS = 3
#: Words in a shingle.
SHINGLE = 3
#: Leaves that the trie is cut into at least, and fingerprints that a leaf should hold beyond that.
LEAVES, LEAF_ROWS = 128, 100_000
#: Depth down to which leaves are chosen by counts: so many bits that the counts, 2 ** DEPTH at most, fit the driver.
DEPTH = 16
#: Node pairs that are expanded at a time, and pairs of fingerprints under which two nodes are compared outright.
FRONT, OUTRIGHT = 1 << 19, 32


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text: a bit is set if over half the shingles' XXH64 (seed 42) have it. No words or null: 0."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    hashed = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= shingle:
        return hashed(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(a), 65536):
        h = np.array([hashed(joined[s:e], 42) for s, e in zip(a[k : k + 65536], b[k : k + 65536])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(a)).tolist()))


@arrow_udf(LongType())
def simhash(text: pa.Array) -> pa.Array:
    """Fingerprint of each text as a signed long."""
    return pa.array(np.array([fingerprint(x) for x in as_bytes(text)], np.uint64).view(np.int64))


def cut_trie(counts: dict[int, int], leaf_rows: int, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """Nodes (prefix left-aligned to 64 bits, bits, block) that hold about leaf_rows each and between them every fingerprint.

    counts: by the first `depth` bits. A node that is still too large at that depth gives several blocks of itself.
    """
    sums = [np.zeros(1 << depth, np.int64)]
    for k, v in counts.items():
        sums[0][k] = v
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(1))
    sums.reverse()
    out, open_ = [], [(0, 0)]
    while open_:
        d, p = open_.pop()
        n = int(sums[d][p])
        if n > leaf_rows and d < depth:
            open_ += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        elif n:
            out += [(p << (64 - d) if d else 0, d, block) for block in range(-(-n // (2 * leaf_rows)) if n > leaf_rows else 1)]
    return sorted(out)


class Deal:
    """Deals fingerprints out to units: a leaf (side 0) with those it meets (side 1), whose common prefixes differ in few enough bits."""

    def __init__(self, leaves: list[tuple[int, int, int]], budget: int):
        self.prefix, self.bits, block = (np.array(x, t) for x, t in zip(zip(*leaves), (np.uint64, np.int64, np.int64)))
        first = np.flatnonzero(block == 0)
        self.first, self.starts, self.blocks = first, self.prefix[first], np.diff(np.append(first, len(block)))
        self.budget, self.known = budget, {}

    def partners(self, leaf: int) -> np.ndarray:
        if leaf not in self.known:
            low = np.minimum(self.bits, self.bits[leaf])
            mask = np.where(low > 0, ~np.uint64(0) << (64 - np.maximum(low, 1)).astype(np.uint64), np.uint64(0))
            self.known[leaf] = np.flatnonzero(np.bitwise_count((self.prefix ^ self.prefix[leaf]) & mask) <= self.budget)
        return self.known[leaf]

    def __call__(self, batches):
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64)
            at = np.searchsorted(self.starts, fp, side="right") - 1
            leaf = self.first[at] + (fp % np.uint64(1_000_003)).astype(np.int64) % self.blocks[at]
            order = np.argsort(leaf, kind="stable")
            leaf, fp = leaf[order], fp[order]
            marks = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else [], len(leaf)).astype(np.int64)
            for lo, hi in zip(marks[:-1], marks[1:]):
                other = self.partners(int(leaf[lo]))
                own = int(leaf[lo])
                unit = np.where((other + own) % 2 == 0, np.minimum(other, own), np.maximum(other, own))  # which of two leaves meets the other
                side = (unit != own).astype(np.int8)
                unit, side = np.unique(np.stack([unit, side]), axis=1)  # its own fingerprints go to a leaf once
                for k in range(lo, hi, 4096):
                    rows = fp[k : min(hi, k + 4096)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(unit, len(rows))), pa.array(np.repeat(side.astype(np.int8), len(rows))), pa.array(np.tile(rows, len(unit)))], ["unit", "side", "fp"])


def linked(a: np.ndarray, b: np.ndarray, same: bool, budget: int, most: int = FRONT, outright: int = 1 << 21):
    """Traverses the tries of two sorted arrays together; yields arrays of index pairs whose values differ in `budget` bits or fewer.

    A front holds pairs of nodes, each a range of its array, with the bits they differ in so far. One level down, each pair gives up to
    four pairs of children; those over the budget are pruned. A front has `most` pairs of nodes, `outright` pairs of values are compared at a time.
    """
    ones = {}

    def count_of(x, key, bit):
        if (key, bit) not in ones:
            ones[key, bit] = np.concatenate(([0], np.cumsum((x >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)))
        return ones[key, bit]

    start = np.array([[0], [len(a)], [0], [len(b)], [0]], np.int64)
    stack = [(0, start)]
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > most:
            half = front.shape[1] // 2
            stack += [(depth, front[:, half:]), (depth, front[:, :half])]
            continue
        al, ah, bl, bh, diff = front
        direct = ((ah - al) * (bh - bl) <= OUTRIGHT) | (depth == 64)
        if direct.any():
            x0, nx, y0, ny = al[direct], (ah - al)[direct], bl[direct], (bh - bl)[direct]
            total = nx * ny
            for lo, hi in blocks(total, outright):
                m = total[lo:hi]
                k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                wide = np.repeat(ny[lo:hi], m)
                i, j = np.repeat(x0[lo:hi], m) + k // wide, np.repeat(y0[lo:hi], m) + k % wide
                good = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    good &= i < j
                if good.any():
                    yield i[good], j[good]
            front = front[:, ~direct]
            al, ah, bl, bh, diff = front
        if not front.shape[1]:
            continue
        ca, cb = count_of(a, 0, depth), count_of(b, 0 if same else 1, depth)
        am, bm = ah - (ca[ah] - ca[al]), bh - (cb[bh] - cb[bl])
        twin = (al == bl) if same else np.zeros(len(al), bool)
        parts = [np.stack([al, am, bl, bm, diff]), np.stack([am, ah, bm, bh, diff]), np.stack([al, am, bm, bh, diff + 1]), np.stack([am, ah, bl, bm, diff + 1])[:, ~twin]]
        down = np.concatenate(parts, 1)
        down = down[:, (down[4] <= budget) & (down[0] < down[1]) & (down[2] < down[3])]
        if down.shape[1]:
            stack.append((depth + 1, down))


def blocks(sizes: np.ndarray, most: int):
    """Index ranges whose sizes add up to `most` or little more."""
    total = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def forest(n: int, pairs) -> np.ndarray:
    """Least index that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def join_unit(pdf: pd.DataFrame, budget: int = MAX_BITS) -> pd.DataFrame:
    """Links of one unit as a spanning forest: one row per fingerprint that isn't the first of its group."""
    fp, side = pdf.fp.to_numpy().view(np.uint64), pdf.side.to_numpy()
    a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
    across = ((i, j + len(a)) for i, j in linked(a, b, False, budget)) if len(a) and len(b) else ()
    root = forest(len(a) + len(b), itertools.chain(linked(a, a, True, budget), across))
    every = np.concatenate((a, b)).view(np.int64)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"u": every[moved], "v": every[root[moved]]})


def fingerprint_links(prints: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """prints(fp long, distinct) -> links (u, v): enough of the pairs within `budget` bits to reach what all of them reach.

    The trie is cut into leaves by the counts of 16-bit prefixes. Leaves within the budget over their common prefix meet in the unit of one
    of them, where their tries are traversed together. A fingerprint goes to the units that its leaf meets: some 40 at a quarter of a million
    fingerprints, whose leaves are about 9 bits deep, and at most 349, half of the 697 prefixes of DEPTH bits within 3, from some hundred
    million on; the copies are 17 bytes each. Beyond that depth leaves are divided into blocks of themselves, which meet one another.
    """
    spark = prints.sparkSession
    counts = {r.p: r["count"] for r in prints.groupBy(F.shiftrightunsigned("fp", 64 - DEPTH).alias("p")).count().collect()}
    n = sum(counts.values())
    if not n:
        return spark.createDataFrame([], "u long, v long")
    leaves = cut_trie(counts, max(16, n // min(max(LEAVES, n // LEAF_ROWS), 1 << DEPTH)))
    dealt = prints.select("fp").mapInArrow(Deal(leaves, budget), "unit long, side byte, fp long")
    return dealt.groupBy("unit").applyInPandas(lambda pdf: join_unit(pdf, budget), "u long, v long")


def near_duplicates(docs: DataFrame, budget: int = MAX_BITS, *more: str) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fp (fingerprint as a signed long), component_id; and `root` if it is named, a fingerprint
    that stands for the component, also where no row of it has an id.

    component_id: the smallest doc_id that links reach, over any number of steps, itself included.
    Texts are fingerprinted whole, however long. Null or wordless text: fingerprint 0, linked like any other. Null doc_id: the row takes part, and has the smallest non-null id of its
    component (null if none). Repeated rows: one row each, in one component. Empty table: no rows. Other columns are ignored.
    """
    own = cut(docs.select("doc_id", simhash(F.col("text")).alias("fp")))
    least = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(fingerprint_links(least.select("fp"), budget))
    placed = least.join(roots, least.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    placed = cut(placed)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(placed.join(ids, "root").select("fp", "component_id", *more))
    return own.join(of, "fp", "left").select("doc_id", "fp", "component_id", *more)


def keep_one(docs: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """docs without near-copies: of each component the row of the smallest doc_id stays, once if it is repeated; columns as before."""
    found = cut(near_duplicates(docs, budget, "root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("fp").alias("f")))
    kept = cut(found.groupBy("root").agg(first.alias("k")).select(F.col("k.d").alias("k_id"), F.col("k.f").alias("k_fp")))
    plain = found.sparkSession.createDataFrame([], docs.schema).columns
    marked = docs.withColumn("__fp", simhash(F.col("text")))
    rows = marked.join(kept, marked["doc_id"].eqNullSafe(kept["k_id"]) & (marked["__fp"] == kept["k_fp"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "__fp"]).select(*plain)
