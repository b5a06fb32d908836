"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, learning_rows, released, slices

#: Characters in the longest sequence.
ORDER = 4
#: Part of a count that goes to shorter sequences.
DISCOUNT = 0.75
#: Share of the learning rows that calibrate rejection, and are not counted: one in so many.
HELD_BACK = 8
#: A text is rejected beyond MARGIN times the excess (in deviations) that only the part FALSE of the calibrating texts of its language has; that
#: excess counts as FLOOR at least, since few texts don't show how far good ones may lie.
FALSE, MARGIN, FLOOR = 0.001, 1.5, 4.0
#: Texts of all languages that the spread of one language is told by, beside its own; its limit is wider by the root of 1 plus their share.
SHARED = 20
#: How sharply the score tells languages apart: probabilities are the softmax of -SHARP times the cross-entropy a character, in nats.
SHARP = 12.0
#: Words that a task remembers before it starts anew.
REMEMBERED = 200_000
#: Words that are counted at a time, and characters that are scored at a time.
HELD, AT_A_TIME = 150_000, 2_000_000
UNKNOWN = "und"
_HEAD = " " * (ORDER - 1)
_LETTERS = re.compile(r"[^\W\d_]+")
_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Key of each run of n code points: all 64 bits of its hash, as a signed long."""
    size = max(len(points) - n + 1, 0)
    return mixed([points[k : size + k] for k in range(n)], size)


def gathered(points: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Keys of the runs of n code points that end at `last`."""
    return mixed([points[last - n + 1 + k] for k in range(n)], len(last))


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter to _LETTERS."""
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, range(0x110000)))
    for m in _LETTERS.finditer(every):
        out[m.start() : m.end()] = True
    return out


def mixed(columns: list[np.ndarray], size: int) -> np.ndarray:
    h = np.full(size, len(columns), np.uint64)
    for c in columns:
        h = (h ^ c) * _SALT[0]
        h ^= h >> np.uint64(29)
    return (h * _SALT[1]).view(np.int64)


def pieces_of(word: str) -> list[str]:
    return _LETTERS.findall(word.lower())


def _words(batches):
    """Number of each word by language, given out whenever HELD of them are held."""
    seen: dict[tuple[str, str], int] = {}

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])
        seen.clear()
        return rows

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang = lang.as_py()
            for w in text.as_py().split():
                seen[lang, w] = seen.get((lang, w), 0) + 1
            if len(seen) > HELD:
                yield out()
    if seen:
        yield out()
    released()


def _grams(batches):
    """ORDER-long sequences of the words, between ORDER - 1 spaces before and one after, summed over some rows."""
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            for w in pieces_of(word):
                s = " " * (ORDER - 1) + w + " "
                for k in range(len(s) - ORDER + 1):
                    key = lang, s[k : k + ORDER]
                    seen[key] = seen.get(key, 0) + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])


def _hash_column(order: int):
    def hashed(gram: pd.Series) -> pd.Series:
        if not len(gram):
            return pd.Series([], dtype="int64")
        points = np.frombuffer("".join(gram).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, order)
        return pd.Series(mixed([points[:, k] for k in range(order)], len(points)))

    return F.pandas_udf(hashed, "long")


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs(text, lang) -> (lang, gram, n) over all rows; words are counted first, so that a frequent one is taken apart once a task."""
    words = docs.select("lang", "text").mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Models:
    """For each order the hashes that any language has, sorted, with every language's log-probability; and what a context leaves to the next
    order. A longer sequence that no language has falls back on the shorter one, at the weight of its context."""

    def __init__(self, langs: list[str], rows: dict[int, pd.DataFrame], heads: dict[int, pd.DataFrame]):
        self.langs = langs
        n = len(langs)
        self.grams, self.contexts = {}, {}
        size = max(int(heads[1]["types"].max()) if len(heads[1]) else 1, 1) + 1
        lower = None
        for order in range(1, ORDER + 1):
            found, head = rows[order], heads[order]
            keys, at = np.unique(found["key"].to_numpy(np.int64), return_inverse=True)
            count = np.zeros((len(keys), n))
            np.add.at(count, (at, found["lang"].to_numpy(np.int64)), found["n"].to_numpy(float))
            ctx, where = np.unique(head["key"].to_numpy(np.int64), return_inverse=True)
            total, types = np.zeros((len(ctx), n)), np.zeros((len(ctx), n))
            np.add.at(total, (where, head["lang"].to_numpy(np.int64)), head["n"].to_numpy(float))
            np.add.at(types, (where, head["lang"].to_numpy(np.int64)), head["types"].to_numpy(float))
            weight = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
            self.contexts[order] = ctx, weight
            # the rows of a key are one sequence in several languages: any of them gives its context and its suffix
            first = found.drop_duplicates("key").sort_values("key")
            c = np.searchsorted(ctx, first["head"].to_numpy(np.int64))
            below = np.full((len(keys), n), 1.0 / size) if lower is None else lower(first["tail"].to_numpy(np.int64))
            p = np.maximum(count - DISCOUNT, 0) / np.maximum(total[c], 1) + weight[c] * below
            self.grams[order] = keys, np.maximum(p, 1e-12)
            if order == 1:
                self.floor = np.where(len(ctx), weight[0] if len(ctx) else 1.0, 1.0) * np.full(n, 1.0 / size)
            lower = lambda tail, o=order: self._found(o, tail)
        self.ready()

    def _found(self, order: int, key: np.ndarray) -> np.ndarray:
        keys, p = self.grams[order]
        out = np.repeat(self.floor[None], len(key), 0)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            out[hit] = p[at[hit]]
        return out

    def log_p(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities of each word by language, and numbers of characters (with the space after)."""
        n = len(self.langs)
        joined = np.frombuffer(" ".join(words).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letters()[joined]
        at = np.flatnonzero(letter)
        if not len(at):
            return np.zeros((len(words), n)), np.zeros(len(words))
        opens = np.append(True, np.diff(at) > 1)
        run = np.cumsum(opens) - 1
        own = np.cumsum(joined == 32)[at[opens]]
        # each run of letters between ORDER - 1 spaces and one more
        points = np.full(len(at) + ORDER * (run[-1] + 1), 32, np.uint64)
        place = np.arange(len(at)) + ORDER * run + ORDER - 1
        points[place] = joined[at]
        sizes = np.bincount(run) + 1
        ends = np.append(np.flatnonzero(opens)[1:], len(at)) - 1
        last = np.sort(np.concatenate((place, place[ends] + 1)))
        p = np.repeat(np.log(self.floor)[None], len(last), 0)
        open_, scale = np.arange(len(last)), None
        for order in range(ORDER, 0, -1):
            h = hashes(points, order)[last - order + 1] if order == ORDER else gathered(points, last[open_], order)
            hit, at = self.place(("gram", order), self.grams[order][0], h)
            rows = self.logs[order][at[hit]]
            p[open_[hit]] = rows if scale is None else rows + scale[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
            scale = np.zeros((len(open_), n)) if scale is None else scale[~hit]
            ctx, weight = self.contexts[order]
            if order > 1:
                c = gathered(points, last[open_] - 1, order - 1)
                hit, at = self.place(("context", order), ctx, c)
                scale[hit] += np.log(weight[at[hit]])
            else:
                p[open_] += scale
        starts = np.cumsum(sizes) - sizes
        each = np.add.reduceat(p, starts, axis=0)
        out = np.zeros((len(words), n))
        np.add.at(out, own, each)
        return out, np.bincount(own, sizes, len(words))

    def place(self, name, keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each asked key is in a sorted array, and where. Keys are hashes, so their first bits tell the place to within a few entries."""
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        if name not in self.starts:
            bits = max(int(len(keys)).bit_length(), 4)
            bounds = (np.arange(1 << bits, dtype=np.int64) - (1 << bits - 1)) << np.int64(64 - bits)
            first = np.searchsorted(keys, bounds)
            self.starts[name] = bits, first, int(np.diff(np.append(first, len(keys))).max())
        bits, first, most = self.starts[name]
        at = first[(asked >> np.int64(64 - bits)) + (1 << bits - 1)]
        at = np.minimum(at, len(keys) - 1)
        for _ in range(most):
            low = keys[at] < asked
            if not low.any():
                break
            at = np.minimum(at + low, len(keys) - 1)
        return keys[at] == asked, at

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("starts", "logs")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ready()

    def ready(self) -> None:
        self.starts = {}
        self.logs = {k: np.log(p) for k, (_, p) in self.grams.items()}


def fit(docs: DataFrame) -> Models:
    """Models of every language, from all rows of docs(text, lang) that have both. Counts are made by Spark; what comes to the driver and is
    broadcast has one entry for each distinct sequence of a language, so it grows with the sequences that the texts have, without a bound."""
    g = cut(gram_counts(docs.where("text is not null and lang is not null")))
    langs = sorted(r.lang for r in g.select("lang").distinct().collect())
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1 if langs else F.lit(0)
    rows, heads = {}, {}
    longer = g.select(number.alias("lang"), "gram", "n")
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # a shorter sequence counts once for every character that comes before it
            longer = longer.groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n"))
        key = lambda c, o: _hash_column(o)(c) if o else F.lit(0).cast("long")
        head, tail = F.substring("gram", 1, order - 1), F.substring("gram", 2, order - 1)
        own = longer.select("lang", key(F.col("gram"), order).alias("key"), key(head, order - 1).alias("head"), key(tail, order - 1).alias("tail"), "n")
        rows[order] = own.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.min(F.struct("head", "tail")).alias("x")).select("lang", "key", "n", "x.head", "x.tail").toPandas().sort_values(["lang", "key"])
        heads[order] = own.groupBy("lang", F.col("head").alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    return Models(langs, rows, heads)


class Scorer:
    """Scores texts; sums of words are remembered. Only the models are sent along."""

    def __init__(self, models: Models):
        self.models = models
        self.forget()

    def __reduce__(self):
        return Scorer, (self.models,)

    def forget(self) -> None:
        self.at, self.sums, self.sizes = {}, np.zeros((0, len(self.models.langs))), np.zeros(0)

    def __call__(self, texts: list[str | None]):
        """Per text: number of the best language (-1: none), its cross-entropy a character, its probability, characters."""
        tokens = [(t or "").split() for t in texts]
        if len(self.at) > REMEMBERED:
            self.forget()
        new = list(set().union(*tokens).difference(self.at)) if tokens else []
        logs, sizes = [self.sums], [self.sizes]
        for lo in range(0, len(new), 20_000):
            a, b = self.models.log_p(new[lo : lo + 20_000])
            logs.append(a)
            sizes.append(b)
        self.at.update(zip(new, range(len(self.sums), len(self.sums) + len(new))))
        self.sums, self.sizes = np.concatenate(logs), np.concatenate(sizes)
        out = []
        for ws in tokens:
            at = np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws))
            n = float(self.sizes[at].sum())
            if not n or not self.models.langs:
                out.append((-1, None, 0.0, 0.0))
                continue
            cross = -self.sums[at].sum(0) / n
            best = int(cross.argmin())
            out.append((best, float(cross[best]), float(1 / np.exp(-SHARP * (cross - cross[best])).sum()), n))
        return out

    def of(self, column: pa.Array):
        """As for a list of texts, some at a time."""
        sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
        return [x for lo, hi in slices(sizes, AT_A_TIME) for x in self(column.slice(lo, hi - lo).to_pylist())]


class Limits:
    """Calibrated rejection by language: the excess over the mean cross-entropy, in deviations for a text of its length, and the most there may be.

    Variances of a language count with those of all, as if SHARED of its texts had them; a language without calibrating texts has the highest mean
    and limit of the others."""

    def __init__(self, rows: list):
        whole = sum(r.n for r in rows)
        pooled = [sum(r.n * max(r[k] or 0.0, 0.0) for r in rows) / max(whole, 1) for k in ("fixed", "by_length")]
        self.by = {r.lang: (r.mean, *(max((r.n * max(r[k] or 0.0, 0.0) + SHARED * x) / (r.n + SHARED), 1e-4 * (k == "fixed")) for k, x in zip(("fixed", "by_length"), pooled))) for r in rows}
        if self.by:
            self.by[UNKNOWN] = tuple(map(max, zip(*self.by.values())))
        self.most: dict[str, float] = {}

    def excess(self, lang: str, cross: float, letters: float) -> float:
        mean, fixed, by_length = self.by[lang]
        return (cross - mean) / (fixed + by_length / letters) ** 0.5

    def rejects(self, lang: str, cross: float | None, letters: float) -> bool:
        """No letter, or further off than calibrating texts of the language are; without any calibrating text none is."""
        own = lang if lang in self.most else UNKNOWN
        return cross is None or own in self.most and self.excess(own, cross, letters) > self.most[own]


def held_back(doc_id) -> F.Column:
    """Learning rows that calibrate and aren't counted."""
    return learning_rows(doc_id) & (F.pmod(F.xxhash64(F.lit(3), doc_id), F.lit(HELD_BACK)) == 0)


def calibrated(docs: DataFrame) -> tuple[Models, Limits]:
    """Models from the learning rows of docs(doc_id, text, lang) but those that are held back, and limits of rejection from these."""
    models = fit(docs.where(learning_rows(F.col("doc_id")) & ~held_back(F.col("doc_id"))))
    scorer, langs = Scorer(models), [*models.langs, UNKNOWN]

    def measured(batches):
        for b in batches:
            best, cross, _, letters = zip(*scorer.of(b.column(0))) if b.num_rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in best], pa.string()), pa.array(cross, pa.float64()), pa.array(letters, pa.float64())], ["lang", "cross", "letters"])
        scorer.forget()
        released()

    rows = docs.where(held_back(F.col("doc_id")) & F.col("lang").isNotNull()).select("text").mapInArrow(measured, "lang string, cross double, letters double")
    rows = cut(rows.where("cross is not null"))
    means = rows.groupBy("lang").agg(F.avg("cross").alias("mean"))  # one row a language, here and below
    square = F.pow(F.col("cross") - F.col("mean"), 2)
    spread = rows.join(F.broadcast(means), "lang").groupBy("lang", "mean").agg(F.regr_intercept(square, 1 / F.col("letters")).alias("fixed"), F.regr_slope(square, 1 / F.col("letters")).alias("by_length"), F.avg(square).alias("whole"), F.count("*").alias("n"))
    limits = Limits(spread.select("lang", "mean", F.when(F.col("fixed") > 0, F.col("fixed")).otherwise(F.col("whole")).alias("fixed"), "by_length", "n").collect())
    if limits.by:
        value = F.create_map(*[x for lang, v in limits.by.items() for x in (F.lit(lang), F.struct(*[F.lit(y) for y in v]))])[F.col("lang")]
        far = (F.col("cross") - value["col1"]) / F.sqrt(value["col2"] + value["col3"] / F.col("letters"))
        found = rows.groupBy("lang").agg(F.percentile_approx(far, F.lit(1 - FALSE), F.lit(100_000)).alias("most"), F.count("*").alias("n")).collect()
        limits.most = {r.lang: MARGIN * max(r.most, FLOOR) * (1 + SHARED / r.n) ** 0.5 for r in found}
        limits.most[UNKNOWN] = max(limits.most.values())
    return models, limits


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score (0 to 1), rejected.

    Learns from all rows that are not held out; lang is no input of a prediction. Null text or text without a letter: `und`, score 0, rejected.
    Of languages with equal cross-entropy the first in alphabetical order wins. Texts are read whole, however long; their words are scored apart.
    No language to learn: `und` for all. Null ids are in no fold; repeated rows: one row each. Empty table: no rows. Other columns are ignored.
    """
    models, limits = calibrated(docs.select("doc_id", "text", "lang"))
    scorer, langs = Scorer(models), [*models.langs, UNKNOWN]

    def predicted(batches):
        for b in batches:
            best, cross, score, letters = zip(*scorer.of(b.column(1))) if b.num_rows else ((),) * 4
            names = [langs[k] for k in best]
            gone = list(map(limits.rejects, names, cross, letters))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])
        scorer.forget()
        released()

    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    found = docs.select("doc_id", "text").mapInArrow(predicted, schema)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected; columns as before, whatever their names, and rows as they were.

    Null text and text without a letter go. Without a language to learn all go, as none can be told. Rows without an id are judged by their text;
    repeated rows stay or go together. Empty table: no rows.
    """
    models, limits = calibrated(docs.select("doc_id", "text", "lang"))
    scorer, langs = Scorer(models), [*models.langs, UNKNOWN]
    at = docs.columns.index("text")

    def known(batches):
        for b in batches:
            found = scorer.of(b.column(at))
            yield b.filter(pa.array([not limits.rejects(langs[k], cross, letters) for k, cross, _, letters in found], pa.bool_()))
        scorer.forget()
        released()

    return docs.mapInArrow(known, docs.schema)
