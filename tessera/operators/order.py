"""Checks and parts of ordered tables, ranks over range partitions, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def is_sorted(df: DataFrame, by: str, value: str, *keys: str) -> DataFrame:
    """(keys, sorted): whether `value` never falls in the order of `by`, within each key. Rows of a key go to one task; a key that holds much of a
    table is better cut into ranges of `by` first, with `ends`."""
    w = W.partitionBy(*keys).orderBy(by)
    return df.withColumn("__before", F.lag(value).over(w)).groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("__before") <= F.col(value), F.lit(True))).alias("sorted"))


def ends(df: DataFrame, by: str, value: str, width: float) -> DataFrame:
    """(slice, first, last, sorted): slices of `by` of a width, in each the values at its ends and whether it is sorted; a table is sorted if every
    slice is, and none begins below the end of the one before."""
    cut = F.floor(F.col(by) / width)
    w = W.partitionBy("__slice").orderBy(by)
    own = df.withColumn("__slice", cut).withColumn("__before", F.lag(value).over(w))
    return own.groupBy(F.col("__slice").alias("slice")).agg(F.min_by(value, by).alias("first"), F.max_by(value, by).alias("last"), F.bool_and(F.coalesce(F.col("__before") <= F.col(value), F.lit(True))).alias("sorted"))


def partition_point(df: DataFrame, by: str, good: Column, *keys: str) -> DataFrame:
    """(keys, partitioned, point): whether rows that hold come before all others in the order of `by`, and how many hold. No window: of both kinds
    the greatest and least place decide."""
    own = df.groupBy(*keys).agg(F.max(F.when(good, F.col(by))).alias("__last"), F.min(F.when(~good, F.col(by))).alias("__first"), F.count_if(good).alias("point"))
    return own.select(*keys, F.coalesce(F.col("__last") < F.col("__first"), F.lit(True)).alias("partitioned"), "point")


def unique_partition(df: DataFrame, by: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in the order of `by`, whose values differ, and the others: an aggregation with map-side combine and two joins, so a
    key with very many rows isn't gathered."""
    first = df.groupBy(*keys).agg(F.min(by).alias("__first")).select("__first")
    return df.join(first, df[by] == first["__first"], "left_semi"), df.join(first, df[by] == first["__first"], "left_anti")


def partition_copy(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold, and the others, those with null among them."""
    yes = F.coalesce(good, F.lit(False))
    return df.where(yes), df.where(~yes)


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """With `rank`, from 1, in the order of some columns: ranks within ranges, then the rows of the ranges before are added."""
    spread = df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id())
    spread = spread.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else spread.persist()
    own = spread.withColumn("__own", F.row_number().over(W.partitionBy("__part").orderBy(*by)))
    sums = spread.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = sums.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return own.join(F.broadcast(before), "__part").withColumn("rank", (F.col("__own") + F.col("__before")).cast("bigint")).drop("__part", "__own", "__before")


def sorted_distinct(c: Column) -> Column:
    """An aggregate: the distinct values in order; for groups of a bounded number of distinct values."""
    return F.array_sort(F.collect_set(c))


def report(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(keys, text): count, mean, deviation, least, median and greatest of a histogram, then a line for each bucket that has values, with its part
    and the part so far. Partial counts merge; a text has 154 buckets at most."""
    from .stats import LIMITS, bucket

    each = df.where(value.isNotNull()).groupBy(*keys, bucket(value).alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    upto = whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    limits = F.array(F.lit(0.0), *[F.lit(x) for x in LIMITS])
    t = each.withColumn("all", F.sum("n").over(whole)).withColumn("sum", F.sum("n").over(upto))
    line = F.format_string("[ %7.0f, %7.0f ) %8d %7.3f%% %7.3f%% %s", F.element_at(limits, F.col("bucket") + 1), F.element_at(limits, F.col("bucket") + 2), "n", 100.0 * F.col("n") / F.col("all"), 100.0 * F.col("sum") / F.col("all"), F.repeat(F.lit("#"), F.rint(20.0 * F.col("n") / F.col("all")).cast("int")))
    made = t.withColumn("line", line).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "line"))).alias("lines"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    head = F.format_string("Count: %d  Average: %.4f  StdDev: %.2f\nMin: %.2f  Max: %.2f\n", "n", mean, deviation, "lo", "hi")
    return made.select(*keys, F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def zone_hours(at: Column, zone: str) -> Column:
    """Hours that a time zone is ahead of UTC at a time."""
    return (F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 3600.0
