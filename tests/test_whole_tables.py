"""Queries over whole tables: no row is left out by its id or place."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_human_elapsed_of_late_orders(spark, tmp_path):
    keys = [1, 499_999, 500_000, 600_000, 40_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.unit, r.amount) for r in QUERIES["human_elapsed"](spark, str(tmp_path)).collect()}
    assert sorted(got) == keys
    assert got[500_000] == ("months", pytest.approx(500_000 * 61 / (30.436875 * 86400), abs=1e-6))
    assert got[600_000] == ("years", pytest.approx(600_000 * 61 / (365.2425 * 86400), abs=1e-6))


def test_human_elapsed_rounds_as_its_sql(spark, tmp_path):
    """Amounts just under a half of the last digit go down."""
    spark.createDataFrame([(k,) for k in (1, 1485, 2889, 2943, 11_421)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.amount for r in QUERIES["human_elapsed"](spark, str(tmp_path)).collect()}
    assert got == {1: 1.016667, 1485: 1.048437, 2889: 2.039687, 2943: 2.077812, 11_421: 8.063437}


def test_squares_of_all_suppliers(spark, tmp_path):
    """Also beside and at the poles: the frame has its area, its hole isn't in it."""
    n = 3000
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    loops = QUERIES["geo_loop"](spark, str(tmp_path)).collect()
    frames = QUERIES["geo_polygon"](spark, str(tmp_path)).collect()
    assert {r.s_suppkey for r in loops} == {r.s_suppkey for r in frames} == set(range(n))
    whole = {r.s_suppkey: r.area for r in loops}
    assert all(0 < r.area < whole[r.s_suppkey] < 0.04 for r in frames)
    assert all(not r.centre and r.frame for r in frames)


def test_double_keys_of_all_customers(spark):
    """The order of the keys is that of the numbers over the whole table, below and above zero."""
    rows = spark.read.parquet(f"{DATA}/customer.parquet").select("c_acctbal", N.double_key("c_acctbal").alias("k")).collect()
    assert any(r.c_acctbal < 0 for r in rows) and any(r.c_acctbal > 0 for r in rows)
    assert [r.c_acctbal for r in sorted(rows, key=lambda r: r.k)] == sorted(r.c_acctbal for r in rows)
