"""Substring dedup by hashing pieces of lines: of a passage that stands together in several places the one of earliest rank stays."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import Memory, written

#: A unit begins with its line, and behind each pair of words whose hash is the least of REACH pairs on both sides. So units begin at the same
#: places in a passage wherever it stands, also amid a line, and have seven words or so.
REACH = 3
#: What is hashed begins with a unit and ends with the first unit that makes up so many words: those stand together in both places.
TOGETHER = 16
#: Words in a passage, made of one or more of these that overlap or touch, from which on it is removed.
PASSAGE = 20
_EDGE = ".,;:!?\"'()[]{}«»„“”‚‘’…*#-–—"
_TIMES = 0x9E3779B97F4A7C15
#: The multiplier's inverse: a product with both is 1 in 64 bits.
_BACK = pow(_TIMES, -1, 1 << 64)
_SPAN = StructType().add("start", "integer").add("end", "integer")


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Units:
    """Takes texts apart; the number of a word is that of its lower-case form without outer punctuation."""

    def __init__(self):
        self.words = Memory(lambda w: xxhash.xxh64_intdigest((w.strip(_EDGE).lower() or w).encode("utf-8", "surrogatepass")))
        self.up, self.down = powers(_TIMES, 1), powers(_BACK, 1)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digest of each stretch of units that has TOGETHER words or little more, its first word, and the word behind it; in order."""
        words, lines = [], []
        for line in text.split("\n"):
            own = line.split()
            if own:
                lines.append(len(words))
                words += own
        n = len(words)
        if n < TOGETHER:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        pair = (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + h[:-1]) >> np.uint64(20)
        padded = np.full(len(pair) + 2 * REACH, np.uint64(1 << 63))
        padded[REACH:-REACH] = pair
        least = np.ones(len(pair), bool)
        for k in range(2 * REACH + 1):
            least &= pair <= padded[k : k + len(pair)]
        starts = np.zeros(n + 1, bool)
        starts[2:] = least  # a unit begins behind the pair
        starts[lines] = starts[n] = True
        starts = np.flatnonzero(starts)
        ends = np.searchsorted(starts, starts + TOGETHER)
        first, last = starts[ends < len(starts)], starts[ends[ends < len(starts)]]
        if n >= len(self.up):
            self.up, self.down = powers(_TIMES, 2 * n), powers(_BACK, 2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((h ^ h >> np.uint64(31)) * self.up[:n], out=sums[1:])
        digest = (sums[last] - sums[first]) * self.down[first]
        digest ^= digest >> np.uint64(32)
        return digest * np.uint64(_TIMES), first, last

    def forget(self) -> None:
        self.words.forget()
        self.up, self.down = powers(_TIMES, 1), powers(_BACK, 1)


_units = Units()


def _digests(batches):
    """Distinct digests of each text, and whether the text has them more than once."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            sizes, out, often = [], [], []
            for text in part.column(2).to_pylist():
                own, times = np.unique(_units(text)[0], return_counts=True)
                sizes.append(len(own))
                out.append(own)
                often.append(times > 1)
            rows = pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(often))], ["doc_id", "of", "digest", "often"])
    _units.forget()


def passages(first: np.ndarray, last: np.ndarray, again: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words under the stretches that come again, where they are long enough."""
    a, b = first[again], last[again]
    if not len(a):
        return []
    ends = np.maximum.accumulate(b)
    opens = np.append(True, a[1:] > ends[:-1])
    a, b = a[opens], ends[np.append(np.flatnonzero(opens)[1:] - 1, len(a) - 1)]
    return [(x, y) for x, y in zip(a.tolist(), b.tolist()) if y - x >= PASSAGE]


def spans(text: str, foreign: list[int]) -> list[tuple[int, int]]:
    """Character ranges to remove: passages whose stretches are in `foreign` or come again in the text."""
    digest, first, last = _units(text)
    if not len(digest):
        return []
    _, where = np.unique(digest, return_index=True)
    again = np.ones(len(digest), bool)
    again[where] = False
    if foreign:
        again |= np.isin(digest.view(np.int64), np.array(foreign, np.int64))
    runs = passages(first, last, again)
    if not runs:
        return []
    at = [m.span() for m in re.finditer(r"\S+", text)]
    if len(at) != len(text.split()):  # \S and split() differ on a few control characters
        at, place = [], 0
        for w in text.split():
            place = text.index(w, place)
            at.append((place, place + len(w)))
            place += len(w)
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the ranges; a line that is left blank goes, and two spaces that meet become one."""
    out, at = "", 0
    for a, b in gone:
        out += text[at:a]
        at = b
        while at < len(text) and text[at] in " \n" and (not out or out[-1] in " \n"):
            at += 1
    return (out + text[at:]).rstrip(" \n") if gone and gone[-1][1] >= len(text.rstrip()) else out + text[at:]


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def repeated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, of, digests) of the texts to look through: `of` is the text's hash, digests are those that a document of
    earlier rank has.

    Each text is taken apart once and its digests are kept as a table in the shared folder. They are counted with map-side combine; a digest
    that very many documents have is a hot key of the join with what repeats, which adaptive execution splits. Rows with one id and text are
    alike, so their digests come together once.
    """
    own = written(docs.select("doc_id", text_hash().alias("of"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_digests, docs.select("doc_id").schema.add("of", "long").add("digest", "long").add("often", "boolean")), "digests")
    twice = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.bool_or("often").alias("within")).where("n > 1 or within").select("digest", "first")
    later = (F.col("doc_id") > F.col("first")) | (F.col("doc_id").isNull() & F.col("first").isNotNull())
    found = own.join(written(twice, "repeated"), "digest").withColumn("later", later).where("later or often")
    return found.groupBy("doc_id", "of").agg(F.collect_set(F.when(F.col("later"), F.col("digest"))).alias("digests"))


def _stripped(docs: DataFrame, columns: list[str], more: bool) -> DataFrame:
    """The columns, text without what repeats; and the ranges that went, if they are asked for."""
    found = repeated(docs).select(F.struct("doc_id", "of").alias("k"), "digests")
    rows = docs.select(F.struct(*columns).alias("row"), F.struct("doc_id", text_hash().alias("of")).alias("k")).alias("d")
    given = rows.join(found.alias("f"), F.col("d.k.doc_id").eqNullSafe(F.col("f.k.doc_id")) & (F.col("d.k.of") == F.col("f.k.of")), "left")
    at = columns.index("text")

    def removed(batches):
        for b in batches:
            own = b.column(0).flatten()
            texts, gone = own[at].to_pylist(), []
            for k, digests in enumerate(b.column(1).to_pylist()):
                ranges = [] if digests is None or not texts[k] else spans(texts[k], digests)
                if ranges:
                    texts[k] = without(texts[k], ranges)
                gone.append([{"start": s, "end": e} for s, e in ranges] if more else None)
            own[at] = pa.array(texts, own[at].type)
            fields = list(b.schema.field(0).type)
            row = pa.StructArray.from_arrays(own, fields=fields)
            yield pa.RecordBatch.from_arrays([row, pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["row", "gone"])
        _units.forget()

    schema = given.select("row").schema.add("gone", ArrayType(_SPAN))
    return given.select("row", "digests").mapInArrow(removed, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text as it stays, and `removed`, the ranges of characters that went from it.

    The rank is doc_id, of any type with an order, then the place in the text. Null ids rank last, and together; rows that share an id have one
    rank and don't count as copies of each other. What an earlier document has, and what the text itself has said before, goes if it stands
    together there and makes up PASSAGE words. Null text stays null, empty text empty. A text is taken apart whole, however long. Repeated rows:
    one row each, stripped alike. Empty table: no rows. Other columns are ignored.
    """
    return _stripped(docs, ["doc_id", "text"], True).select("row.doc_id", "row.text", F.col("gone").alias("removed"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed, as by dedup; columns as before, whatever their names; n_chars counted anew where it is there."""
    rows = _stripped(docs, docs.columns, False).select("row.*")
    return rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows
