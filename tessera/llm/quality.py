"""Quality rules: plain counts of a text, and the fertility of a public tokeniser on it against bands for each language."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, released, tokenizer_path
from .pieces import MODEL

#: Base rule: words at least, and the share of repeated words in percent at most.
WORDS, REPEATED = 10, 20
#: Steps into which values are counted for the bands: characters a token, share of byte pieces, entropy in bits a token, as parts of 1.
STEPS = {"fertility": 0.02, "low": 0.002, "entropy": 0.02}
#: A value is rejected if it lies further from the quartiles than so many times their distance (and a least distance, in its unit).
REACH, LEAST = 4.0, {"fertility": 0.12, "low": 0.02, "entropy": 0.25}
#: What short texts may lie further off, divided by the root of the number of words.
SHORT = {"fertility": 1.0, "low": 0.1, "entropy": 0.5}
_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list) -> int:
    """Words in 5-word windows that are found twice or more in the text, the first included."""
    n = len(words) - 4
    if n < 2:
        return 0
    ids = {x: k for k, x in enumerate(dict.fromkeys(words))}
    w = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    k = len(ids) + 1
    more = np.bincount(w)[w] > 1  # a window can only be found again if each of its words is
    start = np.flatnonzero(more[:n] & more[1 : n + 1] & more[2 : n + 2] & more[3 : n + 3] & more[4:])
    if len(start) < 2:
        return 0
    key = w[start]
    for j in range(1, 5):  # numbers stay small: after two words they are dealt anew
        key = key * k + w[start + j]
        if j in (2, 3) or k > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
            # distinct keys are fewer than the words, so the next product fits 64 bits
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[at] >= 2
    if not twice.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    marks[start[twice]] = 1
    marks[start[twice] + 5] -= 1
    return int((np.cumsum(marks)[:-1] > 0).sum())


def counts(text: bytes, chars: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8 and its number of characters."""
    words = text.split()  # bytes are split at the six blanks, and at nothing else
    seen, twice = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            twice += 1
        elif line.strip():
            seen.add(line)
    blanks, symbols = (len(text) - len(text.translate(None, x)) for x in (_BLANK, _SYMBOLS))
    return len(words), chars - blanks, symbols, twice, repeated_words(words)


@functools.lru_cache(maxsize=2)
def library(model: str = MODEL):
    """The vocabulary's own library, and which of its ids are byte pieces."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
    return own, np.array([own.is_byte(i) for i in range(own.get_piece_size())])


def _measured(batches):
    own, byte = library()
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        columns = [[] for _ in range(8)]
        for text, chars in zip(as_bytes(column), pc.utf8_length(column).to_pylist()):
            text, chars = text or b"", chars or 0
            ids = own.encode(text, out_type="numpy")
            n = len(ids)
            _, times = np.unique(ids, return_counts=True)
            bits = float(-(times / n * np.log2(times / n)).sum() / np.log2(n)) if n > 1 else 0.0
            row = (*counts(text, chars), chars / n if n else 0.0, int(np.count_nonzero(byte[ids])) / n if n else 0.0, bits)
            for c, v in zip(columns, row):
                c.append(v)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64() if k < 5 else pa.float64()) for k, c in enumerate(columns))],
                                         [*batch.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fertility", "low", "entropy"])
    released()


def measures(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, lang, the base counts, characters a token, share of byte pieces, and entropy of the
    tokens as a part of the greatest there can be."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, fertility double, low double, entropy double"
    return docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(_measured, f"doc_id {kind}, lang string, {made}")


def bands(measured: DataFrame) -> DataFrame:
    """(lang, measure, low, high) from the quartiles over all rows that pass the base rules; counts by step, so exact and mergeable."""
    passed = measured.where(~failed())
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.floor(F.col(k) / v).alias("step")) for k, v in STEPS.items()])).alias("m")
    steps = passed.select("lang", each).groupBy("lang", "m.measure", "m.step").count()
    rows: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for r in steps.collect():  # languages times measures times a few hundred steps
        rows.setdefault((r.lang, r.measure), []).append((r.step, r["count"]))
    out = []
    for (lang, measure), own in rows.items():
        step, n = (np.array(x) for x in zip(*sorted(own)))
        total = np.cumsum(n)
        q1, q3 = (float(step[np.searchsorted(total, total[-1] * q)]) * STEPS[measure] for q in (0.25, 0.75))
        far = max(REACH * (q3 - q1), LEAST[measure])
        out.append((lang, measure, q1 - far, q3 + far))
    return out


def failed() -> F.Column:
    return (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    kept: the base rules pass and all three measures lie in the bands of the row's language. Null text: no words, so it fails. Null lang is
    a language of its own, `und`. Values on a band's edge are inside. Texts are read whole, however long. Repeated rows: one row each, and each
    counts for the bands. Empty table: no rows. Other columns are ignored.
    """
    measured = cut(measures(docs))
    limits: dict[str, dict[str, tuple[float, float]]] = {}
    for lang, measure, low, high in bands(measured):
        limits.setdefault(measure, {})[lang] = (low, high)
    inside = F.lit(True)
    for measure, by_lang in limits.items():
        low, high = (F.create_map(*[F.lit(x) for lang, v in by_lang.items() for x in (lang, v[k])])[F.col("lang")] for k in (0, 1))
        slack = F.lit(SHORT[measure]) / F.sqrt(F.greatest("n_words", F.lit(1)))
        inside &= F.coalesce(F.col(measure).between(low - slack, high + slack), F.lit(True))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), (~failed() & inside).alias("kept"), "fertility", "low", "entropy", "lang")
