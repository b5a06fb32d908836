"""Token counts of a public vocabulary, through a cache of content digests."""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from .common import file_digest, folder, hf_tokenizer, released, shared_dir, tokenizer_path, written

#: The vocabulary by default.
VOCABULARY = "byte_bpe_50k.json"


def byte_of() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 signs for themselves, the others in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def rank_table(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks of byte strings and ids of special texts, if a .json file is a byte-level vocabulary whose ids follow the order of its merges."""
    with open(tokenizer_path(vocabulary), "rb") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not file.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("byte_fallback"):
        return None
    made = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in made]
    special = {x["content"]: x["id"] for x in file.get("added_tokens", ())}
    if ids != sorted(set(ids)) or len(ids) + 256 != len(model["vocab"].keys() - special.keys()):
        return None
    sign = byte_of()
    return {bytes(map(sign.__getitem__, t)): k for t, k in model["vocab"].items() if t not in special}, special


class WordIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes: those of the `tokenizers` library for the vocabulary."""

    def __init__(self, table: dict[bytes, int], special: dict[str, int]):
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() if text else b""

    def forget(self) -> None:
        released()


class LibraryIds:
    """Ids of whole texts by the vocabulary's own library, in the same form."""

    def __init__(self, vocabulary: str):
        if vocabulary.endswith(".model"):
            import sentencepiece

            self.ids = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(vocabulary)).encode
        else:
            own = hf_tokenizer(vocabulary)
            self.ids = lambda text: own.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes() if text else b""

    def forget(self) -> None:
        pass


@functools.lru_cache(maxsize=2)
def word_ids(vocabulary: str = VOCABULARY):
    """What encodes for a vocabulary: made from that file alone, a .json, .model or .tiktoken one."""
    if vocabulary.endswith(".tiktoken"):
        with open(tokenizer_path(vocabulary), "rb") as f:
            return WordIds({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {})
    table = rank_table(vocabulary) if vocabulary.endswith(".json") else None
    return WordIds(*table) if table else LibraryIds(vocabulary)


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def n_tokens(vocabulary: str = VOCABULARY):
    """Arrow function: number of tokens of each text; null is empty."""

    @arrow_udf(LongType())
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = word_ids(vocabulary)
        for text in texts:
            yield pa.array([len(ids(x)) // 4 for x in texts_of(text)], pa.int64())
        ids.forget()

    return counted


def content_digest(text) -> F.Column:
    """SHA-256 of the normalised content: null is empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


CACHE = "digest binary, tokenizer string, n_tokens long"


def token_counts(docs: DataFrame, cache: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes (UTF-8), n_tokens.

    cache: folder of a table (digest, tokenizer, n_tokens) that runs leave to later ones, by default one in the shared folder. Contents are joined
    to it by the digests of content and tokenizer file; each distinct content that it lacks is encoded once, and its count is appended. Runs that
    append at the same time leave a count twice, which is read once. A digest that more rows have than a task's share is joined by broadcast:
    there are no more of these than tasks.
    Null text counts as empty: 0 tokens. Null or repeated doc_id and repeated rows: one row each. Texts are encoded whole, however long. Empty
    table: no rows. Other columns are ignored. Special strings inside a text are special tokens, as by the library's default.
    """
    spark = docs.sparkSession
    version = file_digest(vocabulary)
    cache = cache or f"{shared_dir(spark)}/token-counts"
    text = F.coalesce(F.col("text"), F.lit(""))
    asked = written(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest")), "asked")
    misses = docs.select(content_digest(F.col("text")).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    files, at = folder(spark, cache)
    if files.exists(at):
        known = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
        misses = misses.join(known.select("digest").distinct(), "digest", "left_anti")
    misses.select("digest", F.lit(version).alias("tokenizer"), n_tokens(vocabulary)("text").alias("n_tokens")).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = asked.count() // tasks + 1
    often = [bytes(r.digest) for r in asked.groupBy("digest").count().where(F.col("count") > share).select("digest").collect()]
    if not often:
        return asked.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")
    hot = F.broadcast(spark.createDataFrame([(x,) for x in often], "digest binary"))
    some = F.broadcast(written(stored.join(hot, "digest", "left_semi"), "often"))
    parts = asked.join(some, "digest"), asked.join(hot, "digest", "left_anti").join(stored, "digest")
    return parts[0].select("doc_id", "n_bytes", "n_tokens").unionByName(parts[1].select("doc_id", "n_bytes", "n_tokens"))
