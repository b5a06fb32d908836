"""Lines, separated values, whole and compressed files; printing of records as text and separated values."""

from __future__ import annotations

import bz2
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, StructType

from ..functions import strings as S


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value): lines of files, which end with \\n or \\r\\n; empty ones are kept. Files are split, and several are read as one."""
    return spark.read.option("lineSep", "\n").text(list(paths)).select(F.regexp_replace("value", "\r$", "").alias("value"))


def separated(spark: SparkSession, *paths: str, sep: str = ",", skip: int = 0) -> DataFrame:
    """(fields): each line's trimmed fields, blank lines left out; quotes may hold separators, two quotes are one. skip: so many header lines of
    each file, which are those that the first file begins with."""
    found = lines(spark, *paths).where(~S.only_whitespace(F.col("value")))
    if skip:
        head = [r.value for r in lines(spark, paths[0]).limit(skip).collect()]
        found = found.where(~F.col("value").isin(head))
    return found.select(S.split_csv(F.col("value"), sep).alias("fields"))


def whole(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length): the files under a folder, at any depth; none of them is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


@arrow_udf(BinaryType())
def uncompressed(column: pa.Array) -> pa.Array:
    """What gzip, zlib or bzip2 bytes hold, told by their first bytes; other bytes as they are, null where they are broken."""

    def one(data: bytes) -> bytes | None:
        try:
            if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0):
                out = b""
                while data:  # several members may follow one another
                    own = zlib.decompressobj(47)
                    out += own.decompress(data) + own.flush()
                    if not own.eof:
                        return None
                    data = own.unused_data
                return out
            return bz2.decompress(data) if data[:3] == b"BZh" else data
        except (OSError, ValueError, zlib.error):
            return None

    return pa.array([None if x is None else one(x) for x in column.to_pylist()], pa.binary())


def compressed_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, value): lines of files that may be compressed, whatever their names. A file is read by one task."""
    found = spark.read.format("binaryFile").load(list(paths)).select("path", uncompressed("content").cast("string").alias("text"))
    each = found.select("path", F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("value"))
    return each.select("path", F.regexp_replace("value", "\r$", "").alias("value"))


# Printing


def printed(df: DataFrame, short: bool = False) -> Column:
    """Each record in text form: `name: value` for each field that is set, repeated fields once for each value, structs in braces; on lines, or on one."""
    gap, parts = (" " if short else "\n"), []
    for f in df.schema:
        parts.append(_field(F.col(f"`{f.name}`"), f.name, f.dataType, "" if short else "  ", gap))
    return F.array_join(F.flatten(F.array(*parts)), gap)


def _field(c: Column, name: str, kind, indent: str, gap: str) -> Column:
    if isinstance(kind, ArrayType):
        return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(c, lambda x: _field(x, name, kind.elementType, indent, gap))))
    if isinstance(kind, StructType):
        inner = F.flatten(F.array(*[_field(c[f.name], f.name, f.dataType, indent, gap) for f in kind]))
        body = F.array_join(F.transform(inner, lambda x: F.concat(F.lit(indent), F.replace(x, F.lit("\n"), F.lit("\n" + indent)))), gap)
        text = F.concat(F.lit(name + " {" + gap), body, F.lit(gap + "}"))
    else:
        quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r'([\\"])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
        text = F.concat(F.lit(name + ": "), quoted if kind.simpleString() == "string" else c.cast("string"))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))


def joined(*cols: Column, sep: str = ",", null: str = "\\N") -> Column:
    """A line of separated values: in quotes where they hold a separator, a quote or a line end, nulls as they are written."""

    def one(c: Column) -> Column:
        text = c.cast("string")
        risky = text.contains(sep) | text.contains('"') | text.contains("\n")
        return F.coalesce(F.when(risky, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(null))

    return F.concat_ws(sep, *[one(c) for c in cols])


def write_lines(df: DataFrame, text: Column, path: str) -> None:
    """A folder of text files, one line for each row."""
    df.select(text.alias("value")).write.mode("overwrite").text(path)
