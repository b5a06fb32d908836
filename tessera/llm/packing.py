"""Packing by cutting stock: a linear program over patterns of lengths, whose columns a knapsack prices, rounded and dealt to ranked documents."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .tokens import texts_of, word_ids

#: Tokens in a sequence, and the id after every document.
ROOM, END = 1024, 0
#: The linear program ends within this part of its lower bound, or when so many pricings together have saved less than a tenth of it.
GAP, PATIENCE = 0.005, 25
#: Of the columns that a pricing gives, so many of most gain are looked at for a simplex step.
TOGETHER = 32
#: Part of the lengths themselves, as duals, in what columns are priced by at first; it falls by STEP whenever no column helps. Until it is 0,
#: prices are also scattered by this part, so that columns differ.
STEADY, STEP, SCATTER = 0.9, 0.3, 0.02


def padded(size: int, room: int = ROOM) -> int:
    """Tokens that a sequence takes: up to the room, but nothing more at a power of two."""
    return size if size & (size - 1) == 0 else room


class Knapsack:
    """Unbounded knapsack by dynamic programming: for each number of tokens the most that pieces are worth which make up exactly so many."""

    def __init__(self, value: np.ndarray, lengths: np.ndarray, room: int):
        self.lengths, self.room = lengths, room
        best, self.last = np.full(room + 1, -np.inf), np.full(room + 1, -1)
        best[0] = 0.0
        until = np.searchsorted(lengths, np.arange(room + 1), side="right")
        for c in range(1, room + 1):
            if until[c]:
                # of equals the longest piece, so that short ones, which fit anywhere, are left
                got = (value[: until[c]] + best[c - lengths[: until[c]]])[::-1]
                k = int(got.argmax())
                best[c], self.last[c] = got[k], until[c] - 1 - k
        self.best = best
        # for each room the number of tokens within it that is worth most
        self.at = np.zeros(room + 1, np.int64)
        for c in range(1, room + 1):
            self.at[c] = c if best[c] > best[self.at[c - 1]] else self.at[c - 1]
        self.powers = [1 << k for k in range(room.bit_length()) if 1 << k < room and best[1 << k] > 0]

    def dearest(self) -> float:
        """The most that a token of a sequence is worth, its padding counted."""
        return max([best / size for best, size in ((self.best[self.at[self.room]], self.room), *((self.best[c], c) for c in self.powers))])

    def patterns(self) -> np.ndarray:
        """A row of counts for each length: the best pattern that has it; and one for each power of two below the room."""
        ends = np.concatenate((self.at[self.room - self.lengths], np.array(self.powers, np.int64)))
        out = np.zeros((len(ends), len(self.lengths)))
        out[np.arange(len(self.lengths)), np.arange(len(self.lengths))] = 1
        open_ = np.flatnonzero(ends > 0)
        while len(open_):
            k = self.last[ends[open_]]
            np.add.at(out, (open_, k), 1)
            ends[open_] -= self.lengths[k]
            open_ = open_[ends[open_] > 0]
        return out


def solve(lengths: np.ndarray, demand: np.ndarray, room: int = ROOM) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Patterns with how often each is used, so that all demand is met by about the fewest padded tokens, and a lower bound of these.

    Column generation with a revised simplex. It begins with pairs of a long piece and the longest beside it, and
    sequences of one length. Duals price columns by Knapsack; they enter in
    turns while they help. Duals swing far at first, so columns are priced by a mean of them and the lengths (a token costs about
    one), and by the duals alone in the end. It ends when the cost is within GAP of the bound that prices and dearest pattern give, no column helps, or PATIENCE pricings have
    hardly helped.
    """
    m = len(lengths)
    random = np.random.default_rng(1)
    # a slight unevenness keeps degenerate steps from going round
    asked = demand * (1 + 1e-7 * random.random(m))
    basis, cost, spare = np.diag(room // lengths).astype(float), np.zeros(m), asked.copy()
    for k in range(m - 1, -1, -1):
        other = int(np.searchsorted(lengths, room - lengths[k], side="right")) - 1
        if 0 <= other < k:  # a long piece with the longest that goes beside it
            basis[other, k] = 1.0
            spare[other] -= spare[k]
        elif spare[k] < 0:  # more places than pieces
            basis[k, k], spare[k] = -1.0, 0.0
        cost[k] = padded(int(lengths @ basis[:, k]), room) if basis[k, k] > 0 else 0.0
    inverse = np.linalg.inv(basis).T.copy()  # transposed: a row for each length, so that the few lengths of a pattern are read in one piece
    use, least = asked @ inverse, float(lengths @ demand)
    turn, steady, spent = 0, STEADY, []
    while True:
        dual = inverse @ cost
        prices = (steady * lengths + (1 - steady) * np.maximum(dual, 0)) * (1 + (steady > 0) * SCATTER * random.random(m))
        sack = Knapsack(prices, lengths, room)
        least = max(least, float(prices @ demand) / max(sack.dearest(), 1.0))
        spent.append(float(cost @ use))
        if spent[-1] <= least * (1 + GAP) or len(spent) > PATIENCE and spent[-1] > spent[-1 - PATIENCE] * (1 - GAP / 10):
            break
        offered = sack.patterns()
        costs = np.array([padded(x, room) for x in (offered @ lengths).astype(int).tolist()], float)
        gain = offered @ dual - costs
        order = np.flatnonzero(gain > 1e-6 * room)
        if not len(order):
            if not steady:
                break
            steady = max(steady - STEP, 0.0)
            continue
        offered, costs = offered[order], costs[order]
        while True:
            gain = offered @ dual - costs
            some = np.argpartition(-gain, min(TOGETHER, len(gain) - 1))[:TOGETHER]
            some = some[gain[some] > 1e-7 * room]
            n = int(dual.argmin())
            entering, price, helps = offered[some], costs[some], gain[some]
            if dual[n] < -1e-7 * room:  # more places for a length than pieces, at no cost
                entering, price, helps = np.vstack((entering, -np.eye(1, m, n))), np.append(price, 0.0), np.append(helps, -dual[n])
            if not len(helps):
                break
            # of these the one that saves most
            who, what = np.nonzero(entering)
            steps = np.add.reduceat(inverse[what] * entering[who, what][:, None], np.searchsorted(who, np.arange(len(helps))))
            ratio = np.where(steps > 1e-9, use / np.where(steps > 1e-9, steps, 1.0), np.inf)
            outs = ratio.argmin(1)
            k = int((helps * ratio[np.arange(len(helps)), outs]).argmax())
            out, step = int(outs[k]), steps[k]
            much = use[out] / step[out]
            use -= much * step
            use[out] = much
            basis[:, out], cost[out] = entering[k], price[k]
            row = inverse[:, out] / step[out]
            rows = np.flatnonzero(row)
            inverse[rows] -= row[rows, None] * step
            inverse[:, out] = row
            dual -= helps[k] * row
            turn += 1
            if turn % 400 == 0:
                inverse = np.linalg.inv(basis).T.copy()
                use = np.maximum(asked @ inverse, 0)
                dual = inverse @ cost
    return [(basis[:, k].astype(np.int64), float(max(use[k], 0))) for k in range(m) if cost[k]], least


def filled(counts: dict[int, int], room: int) -> list[int]:
    """Pieces that make up the most tokens within the room: sums that can be reached are the bits of a number, longest pieces first."""
    mask, reached, before = (1 << room + 1) - 1, 1, []
    for n in sorted((n for n, k in counts.items() if k and n <= room), reverse=True):
        for _ in range(min(counts[n], room // n)):
            more = reached | reached << n & mask
            if more == reached:
                break
            before.append((n, reached))
            reached = more
    at, out = reached.bit_length() - 1, []
    for n, had in reversed(before):
        if not had >> at & 1:
            out.append(n)
            at -= n
    return out


def plan(counts: dict[int, int], room: int = ROOM) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Patterns (length -> how often) with numbers of sequences that hold exactly counts[length] pieces of each length, and the lower bound of padded tokens.

    Whole parts of the linear program's solution are taken, and of the fractions those from a half on that still fit, largest first; if none
    does, the largest as far as there are pieces, filled up, or pieces that make up a power of two, whichever is padded less. What is left is solved again, until nothing is.
    """
    left = {n: k for n, k in counts.items() if k}
    out: dict[tuple, int] = {}
    bound = 0.0

    def take(own: dict[int, int], times: int) -> None:
        key = tuple(sorted(own.items()))
        out[key] = out.get(key, 0) + times
        for n, k in own.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]

    while left:
        lengths = np.array(sorted(left))
        found, least = solve(lengths, np.array([left[n] for n in lengths.tolist()], float), room)
        bound = bound or least
        used = sorted(((use, {int(lengths[k]): int(pattern[k]) for k in np.flatnonzero(pattern)}) for pattern, use in found), key=lambda x: (-x[0], sorted(x[1].items())))
        before = sum(left.values())
        for use, own in used:
            times = min([int(use + 1e-6), *(left.get(n, 0) // k for n, k in own.items())])
            if times > 0:
                take(own, times)
        for use, own in sorted(used, key=lambda x: (-(x[0] % 1), sorted(x[1].items()))):
            if use % 1 >= 0.5 and all(left.get(n, 0) >= k for n, k in own.items()):
                take(own, 1)
        if sum(left.values()) == before:
            first = Counter({n: min(k, left[n]) for n, k in used[0][1].items() if n in left})
            first.update(filled(Counter(left) - first, room - sum(n * k for n, k in first.items())))
            ways = [first, *(Counter(filled(left, 1 << k)) for k in range(room.bit_length()))]
            sizes = [sum(n * k for n, k in x.items()) for x in ways]
            best = min((k for k, x in enumerate(sizes) if x), key=lambda k: (padded(sizes[k], room) / sizes[k], -sizes[k]))
            take(dict(ways[best]), 1)
    return [(dict(k), v) for k, v in out.items()], bound


def _pieces(batches):
    ids = word_ids()
    end = np.array([END], "<u4").tobytes()
    for batch in batches:
        texts = texts_of(batch.column(1))
        for lo, hi in slices([len(x) for x in texts], 2_000_000):
            rows, start, length, crc, total = [], [], [], [], []
            for k in range(lo, hi):
                own = memoryview(ids(texts[k]) + end)
                n = len(own) // 4
                for s in range(0, n, ROOM):
                    part = own[4 * s : 4 * (s + ROOM)]
                    rows.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    ids.forget()


def _rank(batches):
    """Adds the partition and, for each length, the rank in it."""
    seen = np.zeros(ROOM + 1, np.int64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column("length").to_numpy()
        order = np.argsort(n, kind="stable")
        s = n[order]
        first = np.searchsorted(s, s, side="left")
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n)) - first
        rank += seen[n]
        seen += np.bincount(n, minlength=ROOM + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int64)), pa.array(rank)], [*batch.schema.names, "part", "rank"])


class Place:
    """Gives each ranked piece its sequence and offset."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]], before: dict[tuple[int, int], int]):
        self.before = before
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence, filled = 0, {}
        for own, times in patterns:
            offset = 0
            for n, k in sorted(own.items(), reverse=True):
                slots.setdefault(n, []).append((filled.get(n, 0), k, sequence, offset))
                filled[n] = filled.get(n, 0) + times * k
                offset += n * k
            sequence += times
        self.slots = {n: np.array(x, np.int64).T for n, x in slots.items()}

    def __call__(self, batches):
        for batch in batches:
            n, part, rank = (batch.column(c).to_numpy() for c in ("length", "part", "rank"))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for own in np.unique(n).tolist():
                at = np.flatnonzero(n == own)
                r = rank[at] + np.array([self.before[p, own] for p in part[at].tolist()], np.int64)
                first, times, base, start = self.slots[own]
                k = np.searchsorted(first, r, side="right") - 1
                turn, place = np.divmod(r - first[k], times[k])
                sequence[at], offset[at] = base[k] + turn, start[k] + place * own
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])


def pack(docs: DataFrame) -> DataFrame:
    """One row per piece of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids and END are cut into full sequences and a tail. What counts is the padded length of all sequences: ROOM, or nothing over a
    sequence that ends at a power of two. The histogram of tails (ROOM - 1 lengths at most, so it fits the driver)
    gives the patterns; pieces are ranked within their length by doc_id and start, over range partitions, and the rank decides the place.
    Only the patterns and one number for each partition and length are sent to the tasks.
    Texts are encoded whole, however long. Pieces of equal length, id, start and ids take their places in either order.
    Null or empty text: one piece with END alone. Null and repeated ids, repeated rows: pieces of each row. Empty table: no rows. Other
    columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    found = cut(docs.select("doc_id", "text").mapInArrow(_pieces, schema))
    keys = ["length", "doc_id", "start", "ids_crc32"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = cut(found.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_rank, schema + ", part long, rank long"))
    rows = ranked.groupBy("length", "part").agg(F.count("*").alias("n")).orderBy("length", "part").collect()
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for r in rows:
        before[r.part, r.length] = counts.get(r.length, 0)
        counts[r.length] = before[r.part, r.length] + r.n
    tails = {k: v for k, v in counts.items() if k < ROOM}
    patterns = [({ROOM: 1}, counts[ROOM])] if counts.get(ROOM) else []
    return ranked.mapInArrow(Place(patterns + plan(tails)[0], before), schema + ", sequence_id long, offset long")
