"""Sorted key-value tables as DataFrames: scans, seeks, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rekey(df: DataFrame, key: Column, partitions: int | None = None) -> DataFrame:
    """Adds `key` and sorts by it: range partitions, each sorted, so no partition holds all rows."""
    keyed = df.withColumn("key", key)
    spread = keyed.repartitionByRange(partitions, "key") if partitions else keyed.repartitionByRange("key")
    return spread.sortWithinPartitions("key")


def text_key(col: Column) -> Column:
    """The field as text, so integers sort as decimal strings."""
    return col.cast("string")


def ordered_key(col: Column) -> Column:
    """Eight bytes whose order is that of the signed integers."""
    return F.unhex(F.lpad(F.hex(col.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def reverse_key(col: Column) -> Column:
    """Eight bytes whose order is the reverse of that of the signed integers."""
    return ordered_key(F.bitwise_not(col.cast("long")))


def seek(df: DataFrame, key) -> DataFrame:
    """Rows from the first key that isn't less, in order."""
    return df.where(F.col("key") >= key).orderBy("key")


def approximate_offsets(df: DataFrame, size: Column) -> DataFrame:
    """Bytes before each key. Sums by range of keys first, then within a range, so no window spans the table; there are as many ranges as shuffles
    have partitions. The ranges are kept, so that both readings see the same."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rekey(df, F.col("key"), parts).withColumn("__part", F.spark_partition_id()).withColumn("__size", size.cast("long"))
    spread = spread.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else spread.persist()
    own = F.sum("__size").over(W.partitionBy("__part").orderBy("key").rowsBetween(W.unboundedPreceding, -1))
    sums = spread.groupBy("__part").agg(F.sum("__size").alias("__n"))
    before = sums.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return spread.withColumn("__own", F.coalesce(own, F.lit(0))).join(F.broadcast(before), "__part").withColumn("offset", F.col("__own") + F.col("__before")).drop("__part", "__size", "__own", "__before")


def upsert(base: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """base with rows of new put in or in place; one equi-join, no window."""
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def put_if_absent(base: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    return base.unionByName(new.join(base.select(key), key, "left_anti"))


def delete(base: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default) -> DataFrame:
    """df with `value` found by key, or the default."""
    return df.join(dim.select(on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))
