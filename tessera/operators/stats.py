"""Keyed counters, histograms with fixed buckets, percentiles, counters over sliding seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper limits of the buckets, 1 to 9, then for each power of ten the same sixteen steps, then no limit.
LIMITS = [float(k) for k in range(1, 10)] + [s * 10.0**e / 10 for e in range(1, 10) for s in (10, 12, 14, 16, 18, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90)] + [1e200]


def map_count(df: DataFrame, key: str, delta: Column) -> DataFrame:
    return df.groupBy(key).agg(F.sum(delta).alias("total"))


def map_average(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average"))


def bucket(value: Column) -> Column:
    """Number of the bucket: how many limits are not over the value; the power of ten is told first, then its sixteen steps."""
    v = F.greatest(value.cast("double"), F.lit(0.0))
    out = F.when(v < 10, F.floor(v))
    for e in range(1, 10):
        steps = LIMITS[9 + 16 * (e - 1) + 1 : 9 + 16 * e]
        out = out.when(v < 10.0 ** (e + 1), F.lit(9 + 16 * (e - 1) + 1) + sum((F.when(v >= x, 1).otherwise(0) for x in steps), F.lit(0)))
    return out.otherwise(len(LIMITS) - 1).cast("int")


def histogram(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(keys, bucket, n): partial counts merge, so one shuffle of at most 154 rows a key and task."""
    return df.where(value.isNotNull()).groupBy(*keys, bucket(value).alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def percentile(df: DataFrame, value: Column, p: float) -> DataFrame:
    """One row: the percentile by linear interpolation inside its bucket, within the least and greatest value."""
    table = histogram(df, value)
    every = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(F.lit(0))
    t = table.withColumn("sum", F.sum("n").over(every)).withColumn("all", F.sum("n").over(whole)).withColumn("lo", F.min("least").over(whole)).withColumn("hi", F.max("most").over(whole))
    threshold = F.floor(F.col("all") * (p / 100.0))
    limits = F.array(F.lit(0.0), *[F.lit(x) for x in LIMITS])
    low, high = F.element_at(limits, F.col("bucket") + 1), F.element_at(limits, F.col("bucket") + 2)
    at = low + (high - low) * ((threshold - (F.col("sum") - F.col("n"))) / (F.col("n") + 1))
    first = t.where(F.col("sum") >= threshold).orderBy("bucket").limit(1)
    return first.select(F.least(F.greatest(at, F.col("lo")), F.col("hi")).alias("value"))


#: Seconds of a slice of time: each goes to a task of its own, with what the sums reach back for.
SLICE = 3600


def sum_last(df: DataFrame, second: Column, delta: Column, offset: int, count: int, *keys: str) -> DataFrame:
    """For each second that has events the sum of `count` seconds that end `offset` before it. Time is cut into slices, and a second is also given to
    the slices that reach back to it, so that a key's seconds, or all seconds without one, don't come together in one task."""
    each = df.groupBy(*keys, second.alias("second")).agg(F.sum(delta).alias("n"))
    reach = offset + count - 1
    slices = F.explode(F.sequence(F.floor(F.col("second") / SLICE), F.floor((F.col("second") + reach) / SLICE))).alias("__slice")
    dealt = each.select("*", slices)
    w = W.partitionBy(*keys, "__slice").orderBy("second").rangeBetween(-reach, -offset)
    summed = dealt.withColumn("total", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return summed.where(F.floor(F.col("second") / SLICE) == F.col("__slice")).drop("__slice")


def qps(df: DataFrame, second: Column, *keys: str) -> DataFrame:
    """Whole requests a second over the nine finished seconds before."""
    return sum_last(df, second, F.lit(1), 1, 9, *keys).withColumn("qps", F.floor(F.col("total") / 9)).drop("total")


def hour_counter(df: DataFrame, ts: Column, *keys: str) -> DataFrame:
    """Events of the latest hour that each key has."""
    hours = df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"))
    last = hours.groupBy(*keys).agg(F.max("hour").alias("hour"))
    return hours.join(last, [*keys, "hour"])
