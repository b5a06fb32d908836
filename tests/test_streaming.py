from pyspark.sql import functions as F

from tessera.streaming.counters import decrement_if_enough, metered, run_once, sessions, sliding, tumbling


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", 1_700_000_000 + i * 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    last = spark.createDataFrame([("end", 1_700_000_000 + 10**6)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    last.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_once(tumbling(stream, "ts", 60, "2 days", "k"), f"{tmp_path}/a", f"{tmp_path}/ca")
    got = spark.read.parquet(f"{tmp_path}/a").where("k <> 'end'")
    want = df.groupBy("k", F.window("ts", "60 seconds")["start"].alias("start")).agg(F.count("*").alias("n"))
    assert got.exceptAll(want.select("k", "start", "n")).isEmpty() and got.count() <= want.count()
    run_once(sliding(stream, "ts", 5, 60, F.lit(1), "2 days", "k"), f"{tmp_path}/b", f"{tmp_path}/cb")
    whole = df.groupBy("k", F.window("ts", "300 seconds", "60 seconds")["end"].alias("end")).agg(F.sum(F.lit(1)).alias("total"))
    assert spark.read.parquet(f"{tmp_path}/b").where("k <> 'end'").exceptAll(whole.select("k", "end", "total")).isEmpty()


def test_take_only_what_is_there(spark, tmp_path):
    """Three batches of one key: bins fill and are drawn from; state goes on between batches, a new bin begins at zero."""
    batches = [[("a", 10, 5), ("a", 10, -3), ("b", 10, -1)], [("a", 10, -3), ("a", 10, 2), ("a", 10, -4)], [("a", 11, -1), ("a", 9, -1), ("a", 11, 1)]]
    for rows in batches:
        spark.createDataFrame(rows, "k string, s long, d long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, s long, d long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_once(metered(decrement_if_enough(stream, "k", "s", "d")), f"{tmp_path}/out", f"{tmp_path}/c")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # 5 - 3 = 2; 2 + 2 = 4: 3 are taken, then 4 aren't there; in bin 11 the one that comes is taken; bin 9 is over
    assert got == [("a", 9, 0, False), ("a", 10, 1, False), ("a", 10, 4, True), ("a", 10, 5, True), ("a", 11, 1, True), ("b", 10, 0, False)]


def test_sessions(spark, tmp_path):
    rows = [("a", 100), ("a", 105), ("a", 200), ("b", 101), ("end", 10**7)]
    spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    run_once(sessions(stream, "ts", "30 seconds", "1 second", "k"), f"{tmp_path}/out", f"{tmp_path}/c")
    assert sorted((r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.k != "end") == [("a", 1), ("a", 2), ("b", 1)]
