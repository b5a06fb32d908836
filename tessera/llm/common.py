"""What the operators share: reading a table, cutting lineage in the shared folder, text helpers."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows in an Arrow batch of texts.
BATCH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a
    cluster, whose executors wouldn't share it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def folder(spark: SparkSession, path: str):
    """Hadoop's file system and path of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a Parquet table of this session in the shared folder, to be read more than once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = folder(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def wide(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by keys over as many partitions as shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def learning_rows(doc_id: Column) -> Column:
    """True for rows that models may learn from: crc32 of the id as text, mod 4, isn't 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return texts.cast(kind).to_pylist() if len(texts) else []


def fresh(name: str, taken: list[str]) -> str:
    """The name, behind so many underscores that no column has it."""
    known = {x.lower() for x in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Arrow functions BATCH rows at a time, unless the session has a number of its own: a batch of the default ten thousand
    would take up as many texts at once, several times over, in the executor and in its worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH))


def released() -> None:
    """Gives memory that a task has freed back to the system; workers live on and others start beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Memory(dict):
    """What a task remembers of words; it starts anew beyond MOST bytes, an entry counted as ENTRY and its word."""

    MOST, ENTRY = 32 << 20, 160

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, word):
        value = self.make(word)
        self.held += self.ENTRY + len(word)
        if self.held > self.MOST:
            self.clear()
            self.held = self.ENTRY + len(word)
        self[word] = value
        return value

    def forget(self) -> None:
        """For the end of a task."""
        self.clear()
        self.held = 0
        released()


def slices(sizes: list[int], most: int):
    """Index ranges whose sizes add up to about `most`."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def hf_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(name))
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=8)
def file_digest(name: str) -> str:
    """Version of a tokenizer: SHA-256 of its file."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
