import math
from collections import Counter

import duckdb
import pytest

from tessera.functions import geo
from tessera.queries import ORACLE, QUERIES, coordinates

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows):
    return sorted(tuple("null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def unsigned(c):
    return c & (1 << 64) - 1


def cells_at(cells, level):
    """Cells of a level that larger or equal ones hold."""
    bit, out = 1 << 2 * (30 - level), set()
    for c in map(unsigned, cells):
        low = c & -c
        out |= set(range(c - low + bit, c + low, 2 * bit))
    return out


def customers(spark, level):
    """(nation, customer, cell of a level) of every customer."""
    own = coordinates(spark.read.parquet(f"{DATA}/customer.parquet"), "c_custkey").select("c_nationkey", "c_custkey", geo.parent(geo.cell_id("lat", "lng"), level).alias("cell"))
    return [(r.c_nationkey, r.c_custkey, unsigned(r.cell)) for r in own.collect()]


def check_sample(spark, df):
    rows = [tuple(r) for r in df.collect()]
    known = {tuple(r) for r in spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey").collect()}
    assert len(rows) == len(set(rows)) == 100 and set(rows) <= known


def check_coverings(spark, df):
    s = {r.s_suppkey: unsigned(r.cell) for r in coordinates(spark.read.parquet(f"{DATA}/supplier.parquet"), "s_suppkey").select("s_suppkey", geo.cell_id("lat", "lng").alias("cell")).collect()}
    rows = df.collect()
    assert len(rows) == len(s)
    for r in rows:
        spans = [(u - (u & -u) + 1, u + (u & -u) - 1) for u in map(unsigned, r.cells)]
        assert len(spans) <= 8 and any(a <= s[r.s_suppkey] <= b for a, b in spans)


def check_normalized(spark, df):
    want = {}
    for nation, _, cell in customers(spark, 4):
        want.setdefault(nation, set()).add(cell)
    got = {r.c_nationkey: r.cells for r in df.collect()}
    assert {k: cells_at(v, 4) for k, v in got.items()} == want
    for cells in got.values():
        siblings = Counter((c & -(4 * (c & -c)) | 4 * (c & -c), c & -c) for c in map(unsigned, cells))
        assert max(siblings.values()) < 4


def check_set_operations(spark, df):
    rows = customers(spark, 3)
    for r in df.collect():
        a, b = ({c for n, k, c in rows if n == r.c_nationkey and k % m == 0} for m in (2, 3))
        assert (cells_at(r.either, 3), cells_at(r.both, 3), cells_at(r.only, 3)) == (a | b, a & b, a - b)


#: Queries that SQL can't express, each with a plain version.
PLAIN = {"sample_k": check_sample, "geo_covering": check_coverings, "geo_cellunion_normalize": check_normalized, "geo_cellunion_setops": check_set_operations}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name not in ORACLE:
        PLAIN[name](spark, df)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    rel = con.sql(ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    own = [tuple(r[n] for n in names) for r in df.collect()]
    at = [rel.columns.index(n) for n in names]
    assert shown(own) == shown([tuple(r[k] for k in at) for r in rel.fetchall()])
    assert math.isfinite(len(own))
