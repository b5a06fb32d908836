"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, cut, held_out, learning_rows

#: Insults that count from the start.
SEED = "idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown fool imbecile retard bastard bitch asshole dickhead jerk freak creep pig vermin filth cretin dimwit halfwit numbskull bonehead wanker twat prick cunt slut whore shit crap bullshit fuck fucking fucker damn ugly hate kill die".split()
#: Words of the second person in some languages.
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch tu te ti tú tus usted ustedes vosotros toi ton ta tes vous votre vos".split()
#: Labelled rows that a model is fitted on at most, least hash of the id first.
SAMPLE = 20_000
#: A term is learned if so many toxic texts have it and it is so much more frequent in them.
LEAST, RATIO = 4, 20.0
#: Score from which a text is called toxic.
TOXIC = 0.3
#: Signs that stand for letters in disguised words.
LEET = str.maketrans("013457@$!|+", "oieastasiit")
PREFIXES = (4, 5, 6)
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"?", b"#$%&*@|<>~^_+=\\/", b"0123456789", b".,;:'\"()-"), 1):
    _CLASS[list(_chars)] = _k


def bare(token: str) -> str:
    return token.strip(".,;:!?\"'()[]{}*#$%&|<>~-_").lower()


def terms(word: str) -> list[str]:
    """A word and the stems that it begins with; stems end in a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []


class Features:
    """Dense features of a text, given the learned terms. What is remembered of tokens isn't sent along."""

    def __init__(self, learned: list[str]):
        self.learned, self.seed, self.you = frozenset(learned), frozenset(SEED), frozenset(YOU)
        self.seen = Memory(self.kind)

    def __reduce__(self):
        return Features, (sorted(self.learned),)

    def kind(self, token: str) -> int:
        """Bits: 1 seed insult, 2 learned term, 4 second person, 8 disguised insult, 16 mixed letters and signs, 32 stretched letters."""
        word = bare(token)
        out = (word in self.seed) | 2 * any(t in self.learned for t in terms(word)) | 4 * (word in self.you)
        if word and not word.isalpha():
            plain = re.sub(r"[\W_]+", "", word.translate(LEET))
            out |= 8 * (not out & 3 and (plain in self.seed or any(t in self.learned for t in terms(plain)[:1])))
            out |= 16 * bool(re.search(r"[^\W\d_][\d@$!|*]+[^\W\d_]", word))
        short = re.sub(r"(.)\1{2,}", r"\1", word)
        if short != word:
            out |= 32 | 8 * (not out & 3 and short in self.seed)
        return out

    def __call__(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        kinds = list(map(self.seen.__getitem__, tokens))
        n = max(len(tokens), 1)
        bits = np.array(kinds, np.int64)
        hit = np.flatnonzero(bits & 11)
        you = np.flatnonzero(bits & 4)
        close = 0
        if len(hit) and len(you):
            at = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(you[np.maximum(at - 1, 0)] - hit))
            close = int((gap <= 5).sum())
        thick = int(np.bincount(hit // 50).max()) if len(hit) else 0
        raw = np.frombuffer((text or "").encode(), np.uint8)
        signs = np.bincount(_CLASS[raw], minlength=7) / max(len(raw), 1)
        seeds, learned, hidden = (int((bits & b > 0).sum()) for b in (1, 2, 8))
        return [seeds / n, learned / n, math.log1p(seeds), math.log1p(learned), math.log1p(hidden), thick, len({tokens[i] for i in hit.tolist()}) if len(hit) else 0, close / n, close / max(len(hit), 1),
                signs[1], signs[2], signs[3], signs[4], signs[5], signs[6], float((bits & 16 > 0).sum()) / n, float((bits & 32 > 0).sum()) / n, math.log1p(len(tokens))]


class Boosted:
    """Gradient-boosted trees for log-loss over histograms of quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        extra = [np.unique(c)[:1] for c in x.T]  # rare features: the least value against the others
        self.edges = [np.unique(np.concatenate((a, b))) for a, b in zip(self.edges, extra)]
        b = self.binned(x)
        self.base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = []
            self.grow(b, y - p, p * (1 - p), np.arange(len(y)), DEPTH, tree)
            self.trees.append(tree)
            f += RATE * self.leaf(tree, b)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)

    def grow(self, b, g, h, rows, depth, tree) -> int:
        at = len(tree)
        tree.append(None)
        best = (1e-6, 0, 0)
        if depth and len(rows) >= 10:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for k, e in enumerate(self.edges):
                if not len(e):
                    continue
                lg = np.cumsum(np.bincount(b[rows, k], g[rows], len(e) + 1))[:-1]
                lh = np.cumsum(np.bincount(b[rows, k], h[rows], len(e) + 1))[:-1]
                gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), k, int(gain.argmax()))
        if best[0] <= 1e-6:
            tree[at] = (-1, 0, float(g[rows].sum() / (h[rows].sum() + 1)), 0)
            return at
        _, k, cut_at = best
        low = b[rows, k] <= cut_at
        left = self.grow(b, g, h, rows[low], depth - 1, tree)
        right = self.grow(b, g, h, rows[~low], depth - 1, tree)
        tree[at] = (k, cut_at, left, right)
        return at

    def leaf(self, tree, b) -> np.ndarray:
        out = np.empty(len(b))
        open_ = [(0, np.arange(len(b)))]
        while open_:
            at, rows = open_.pop()
            k, cut_at, left, right = tree[at]
            if k < 0:
                out[rows] = left
            else:
                low = b[rows, k] <= cut_at
                open_ += [(left, rows[low]), (right, rows[~low])]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + RATE * sum(self.leaf(t, b) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step function nearest to y over x, by pooling adjacent violators; ends drawn in by one row each."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            v, n, _, hi = pools.pop()
            u, m, lo, _ = pools.pop()
            pools.append([(u * m + v * n) / (m + n), m + n, lo, hi])
    points = [(p, (v * n + 0.0) / n) for v, n, lo, hi in pools for p in ((lo, hi) if hi > lo else (lo,))]
    return np.array([p for p, _ in points]), np.clip(np.array([v for _, v in points]), 0.001, 0.999)


class Model:
    """Terms, trees and calibration; without labels of both kinds the share of seed insults decides."""

    def __init__(self, learned: list[str], rows: list[tuple[list[float], int, int]]):
        self.features, self.trees = Features(learned), None
        if len({y for _, y, _ in rows}) == 2:
            x, y, fold = (np.array(v, float) for v in zip(*rows))
            fit = fold != 0
            if len(set(y[fit])) == 2:
                self.trees = Boosted(x[fit], y[fit])
                own = fold == 0 if len(set(y[~fit])) == 2 else fit
                self.points = isotonic(self.trees.margin(x[own]), y[own])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), -1)
        if not len(x):
            return np.zeros(0)
        if not self.trees:
            return 1 - np.exp(-50 * x[:, 0])
        wordless = x[:, -1] == 0  # they have the least score there is
        return np.where(wordless, self.points[1][0], np.interp(self.trees.margin(x), *self.points))


def _counted(batches):
    """Texts of each kind that have a term, summed over some rows."""
    for batch in batches:
        counts = [Counter(), Counter()]
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update({t for w in set(map(bare, (text or "").split())) for t in terms(w)})
        names = [t for t, n in counts[1].items()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([0] * len(names), pa.int64())], ["term", "t", "n"])
        names = list(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], ["term", "t", "n"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on SAMPLE labelled rows at most (ids with least hash, so the same ones for the same ids), of those that may be learned from.

    The sample's ids have that bound, so they are broadcast; of several rows with one of them the least text counts, so the bound holds for texts
    too. Labels other than 0 and 1, null ids and null labels are left out; of several labels for an id the largest counts.
    """
    known = labels.where(learning_rows(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    fold = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)).cast("int").alias("fold")
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = cut(found.select("text", "toxic", fold))
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    learned: list[str] = []
    if len(totals) == 2:
        # terms are chosen on the folds that grow trees, so that calibration sees features as new texts have them
        shown = {r.toxic: r["count"] for r in rows.where("fold != 0").groupBy("toxic").count().collect()}
        counts = rows.where("fold != 0").select("text", "toxic").mapInArrow(_counted, "term string, t long, n long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        rate = ((F.col("t") + 0.5) / (shown.get(1, 0) + 1)) / ((F.col("n") + 0.5) / (shown.get(0, 0) + 1))
        # each has been seen in LEAST of the sample's texts, so they are bounded with it
        learned = [r.term for r in counts.where((F.col("t") >= LEAST) & (rate >= RATIO)).collect()]
    maker = Features(learned)

    def made(batches):
        own = maker
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "toxic", "fold"])

    found = rows.mapInArrow(made, "x array<double>, toxic int, fold int").collect()
    return Model(learned, sorted((r.x, r.toxic, r.fold) for r in found))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Score of each text, a bounded number of texts at a time."""
    found = [model.scores(texts.slice(k, 1000).to_pylist()) for k in range(0, len(texts), 1000)]
    return np.concatenate(found) if found else np.zeros(0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted (1 from TOXIC on).

    score: 0 to 1; null, empty and blank texts have no insults and get the least score of all. Texts are read whole, however long. Null ids are in no
    fold. Repeated rows: one row each, with one score. Empty tables: no rows, or scores by the seed insults where no labels of both kinds are.
    Other columns are ignored, whatever their names.
    """
    model = fit(docs, labels)

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1), model))], ["doc_id", "score"])
        model.features.seen.forget()

    found = docs.select("doc_id", "text").mapInArrow(scored, docs.select("doc_id").schema.add("score", "double"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are called toxic; columns as before, whatever their names, and rows as they were.

    Null and empty texts stay, as they have no insults; so do rows without an id, by their text. Repeated rows stay or go together. Empty table: no rows.
    """
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def clean(batches):
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at), model) < TOXIC))
        model.features.seen.forget()

    return docs.mapInArrow(clean, docs.schema)
