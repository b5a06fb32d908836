"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf, coalesce, lit
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import released, slices, tokenizer_path

#: The model, and the sign it has for a space.
MODEL, SPACE = "piece_bpe_32k.model", "▁"
#: Bytes that a task remembers of words before it starts anew. Symbols beyond which a segment is merged by a heap, in the same order: it has one
#: merge a round, so that rounds over it would take quadratic time.
REMEMBERED, LONG = 48 << 20, 256
#: Rank of a pair that is no piece.
NEVER = np.int64(1) << 40


class Pieces:
    """The model's vocabulary as arrays: symbols are piece ids, or `size` plus the code point of a character that is no piece."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        self.size = n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        odd = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        known = {p: i for i, p in enumerate(names) if not odd[i]}
        self.chars = np.arange(n, n + 0x110000)
        for p, i in known.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        symbol = lambda p: known.get(p, n + ord(p) if len(p) == 1 else None)
        scores = {i: r for r, i in enumerate(sorted({lib.get_score(i) for i in known.values()}, reverse=True))}
        rows = []
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    rows.append((a << 21 | b, i, scores[lib.get_score(i)]))
        rows.sort()
        self.pairs, self.merged, self.rank = (np.array(x, np.int64) for x in zip(*rows))
        self.table = {a: (b, c) for a, b, c in rows}
        joins = {ord(a) << 21 | ord(b) for p in known for a, b in zip(p, p[1:])}
        self.joins = np.array(sorted(joins), np.int64)
        self.bytes_id = {lib.id_to_piece(i): i for i in range(n) if lib.is_byte(i)}
        self.byte0 = self.bytes_id["<0x00>"]
        self.control = {i for i in range(n) if lib.is_control(i)}
        spelled = []
        for i, p in enumerate(names):
            if lib.is_byte(i):
                spelled.append(bytes([int(p[3:5], 16)]))
            elif lib.is_control(i):
                spelled.append(b"")
            elif lib.is_unknown(i):
                spelled.append(" ⁇ ".encode())
            else:
                spelled.append(p.replace(SPACE, " ").encode())
        self.spelled = spelled
        self.decimal = [b"%d," % i for i in range(n)]
        self.digits = np.array([len(x) for x in self.decimal])
        self.space_first = np.array([p.startswith(SPACE) and not odd[i] for i, p in enumerate(names)])
        #: Whether SPACE follows another character in no piece, so that words can be encoded alone.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in known)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, tuple[bytes, bytes, int]] = {}
        self.held = 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 21 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.rank[at], NEVER), self.merged[at]

    def heap(self, sym: list[int]) -> list[int]:
        """Merges one long segment: pair of least rank first, the leftmost of equals."""
        n = len(sym)
        before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
        queue = []

        def offer(i):
            j = after[i]
            if j < n and (t := self.table.get(sym[i] << 21 | sym[j])):
                heapq.heappush(queue, (t[1], i, j, sym[i], sym[j], t[0]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, j, a, b, to = heapq.heappop(queue)
            if gone[i] or gone[j] or sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], gone[j], after[i] = to, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, g in zip(sym, gone) if not g]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin and end. All words are merged together: in a round every segment merges its leftmost pair of least rank."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.chars[points]
        opens = np.ones(len(points), bool)
        if len(points) > 1:
            key = points[:-1] << 21 | points[1:]
            at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            opens[1:] = (self.joins[at] != key) | (word[1:] != word[:-1])
        seg = np.cumsum(opens) - 1
        size = np.bincount(seg)[seg] if len(seg) else seg
        pos = np.arange(len(points))
        done_pos, done_sym = [pos[size == 1]], [sym[size == 1]]
        for lo in np.flatnonzero(opens & (size > LONG)).tolist():
            out = self.heap(sym[lo : lo + int(size[lo])].tolist())
            done_sym.append(np.array(out))
            done_pos.append(pos[lo : lo + len(out)])
        live = (size > 1) & (size <= LONG)
        pos, sym, seg = pos[live], sym[live], seg[live]
        while len(sym):
            rank, to = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
            same = np.flatnonzero(seg[:-1] == seg[1:])
            rank[same], to[same] = self.ranks(sym[same], sym[same + 1])
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            sizes = np.diff(np.append(first, len(sym)))
            # a place in its segment is LONG at most, whatever the number of symbols
            best = np.minimum.reduceat(rank * (LONG + 1) + np.arange(len(sym)) - np.repeat(first, sizes), first)
            able = best < NEVER * (LONG + 1)
            at = first[able] + best[able] % (LONG + 1)
            keep = np.ones(len(sym), bool)
            sym[at] = to[at]
            keep[at + 1] = False
            going = np.repeat(able, sizes)
            done_pos.append(pos[~going])
            done_sym.append(sym[~going])
            keep &= going
            pos, sym, seg = pos[keep], sym[keep], seg[keep]
        pos, sym = np.concatenate(done_pos), np.concatenate(done_sym)
        order = np.argsort(pos, kind="stable")
        pos, sym = pos[order], sym[order]
        word = word[pos]
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):  # characters that are no piece become the pieces of their bytes
            spelled = [np.frombuffer(chr(s - self.size).encode(), np.uint8).astype(np.int64) + self.byte0 for s in sym[odd].tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(x) for x in spelled]
            word = np.repeat(word, times)
            put = np.repeat(np.isin(np.arange(len(sym)), odd), times)
            sym = np.repeat(sym, times)
            sym[put] = np.concatenate(spelled)
        return sym, np.searchsorted(word, np.arange(len(words) + 1))

    def split(self, text: str) -> list[str]:
        """Words with their leading spaces, as in the sign's form; every text gets one space before it."""
        text = text.replace(SPACE, " ")
        if not self.by_word:
            return [" " + text]
        parts = text.split(" ")
        return [" " + p for p in parts] if "" not in parts else re.findall(" *[^ ]+| +", " " + text)

    def encode_words(self, texts: list[str]) -> list[list[tuple[bytes, bytes, int]]]:
        """Per text its words as (ids as uint32 bytes, decimal ids each with a comma, number of byte pieces)."""
        split = [self.split(x) if x else [] for x in texts]
        if self.held > REMEMBERED:
            self.forget()
        new = list(set().union(*split).difference(self.words))
        start, total = 0, 0
        for k, w in enumerate([*new, ""]):
            total += len(w)
            if total > 1 << 20 or k == len(new):
                self.remember(new[start : k + 1])
                start, total = k + 1, 0
        return [list(map(self.words.__getitem__, ws)) for ws in split]

    def remember(self, new: list[str]) -> None:
        if not new:
            return
        ids, ends = self.merge([w.replace(" ", SPACE) for w in new])
        raw, decimal = ids.astype("<u4").tobytes(), b"".join(map(self.decimal.__getitem__, ids.tolist()))
        at = np.concatenate(([0], np.cumsum(self.digits[ids])))[ends].tolist()
        low = np.concatenate(([0], np.cumsum((ids >= self.byte0) & (ids < self.byte0 + 256))))[ends]
        ends, low = (4 * ends).tolist(), np.diff(low).tolist()
        for k, w in enumerate(new):
            self.held += 300 + len(w) + 3 * (ends[k + 1] - ends[k])
            self.words[w] = raw[ends[k] : ends[k + 1]], decimal[at[k] : at[k + 1]], low[k]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(w[0] for w in self.encode_words([text])[0]), "<u4").tolist()

    def decode(self, ids) -> str:
        """The library's decode(ids): byte pieces are put together, bytes that are no UTF-8 become U+FFFD, the first space goes."""
        return self.decode_bytes(ids).decode("utf-8", "each_byte")

    def decode_bytes(self, ids) -> bytes:
        spelled = self.spelled
        out = b"".join([spelled[i] for i in ids])
        first = next((i for i in ids if i not in self.control), None)
        return out[1:] if first is not None and self.space_first[first] else out


def _each_byte(e: UnicodeDecodeError):
    return "�" * (e.end - e.start), e.end


def _register() -> None:
    import codecs

    codecs.register_error("each_byte", _each_byte)


_register()


@functools.lru_cache(maxsize=2)
def pieces(model: str = MODEL) -> Pieces:
    return Pieces(model)


#: Characters of text that are encoded at a time.
AT_A_TIME = 4_000_000


def encoded(texts: list[str]):
    """Words of each text, as Pieces.encode_words has them, some texts at a time."""
    own = pieces()
    for lo, hi in slices([len(x) for x in texts], AT_A_TIME):
        yield from own.encode_words(texts[lo:hi])


@arrow_udf(ArrayType(IntegerType()))
def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Ids of each text, without begin or end ids; null stays null."""
    for text in columns:
        texts = text.to_pylist()
        ids = [b"".join([w[0] for w in ws]) for ws in encoded([x or "" for x in texts])]
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)), mask=pa.array([x is None for x in texts]))
    pieces().forget()
    released()


@arrow_udf(StringType())
def decode(ids: pa.Array) -> pa.Array:
    """The text of each list of ids, as the library's decode(ids); null stays null."""
    return pa.array([None if x is None else pieces().decode(x) for x in ids.to_pylist()], pa.string())


def _digests(batches):
    own = pieces()
    for batch in batches:
        counts, ids_sha, text_sha = [], [], []
        for words in encoded(batch.column(1).to_pylist()):
            ids = np.frombuffer(b"".join([w[0] for w in words]), "<u4").tolist()
            decoded = own.decode(ids)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(b"".join([w[1] for w in words])[:-1]).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    own.forget()
    released()


def piece_digests(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_tokens, SHA-256 of the decimal ids joined by commas, and of the text that decode()
    makes of them; both in one pass, as `encode` and `decode` give them.

    Null text is empty: no ids, and the empty text. Texts are encoded whole: equal to the library's ids also for words of millions of characters.
    Null or repeated ids and repeated rows: one row each. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", coalesce("text", lit("")).alias("text")).mapInArrow(_digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
