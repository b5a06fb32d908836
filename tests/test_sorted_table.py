import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import tables
from tessera.sources import sorted_table as S
from tessera.sources.list_file import Corrupt


def opened(data):
    return S.Table(lambda at, n: data[at : at + n], len(data))


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 500])
@pytest.mark.parametrize("compress", [True, False])
def test_against_a_dict(n, compress):
    r = random.Random(n)
    rows = dict(sorted({r.randbytes(r.randint(0, 6)): r.randbytes(r.choice((0, 5, 300))) for _ in range(n)}.items()))
    t = opened(b"".join(S.encode(rows.items(), {"foo": "bar", "1": "2", "8": "3" * 300}, compress, 256)))
    assert list(t.scan()) == list(rows.items()) and t.meta() == {"foo": "bar", "1": "2", "8": "3" * 300}
    for low in [b"", b"\xff" * 9, *r.sample(list(rows), min(5, len(rows)))]:
        assert list(t.scan(low)) == [x for x in rows.items() if x[0] >= low]
        high = low + b"\x80"
        assert list(t.scan(low, high)) == [x for x in rows.items() if low <= x[0] <= high]
    at = [t.approximate_offset(k) for k in rows]
    assert at == sorted(at)


def test_faults():
    data = b"".join(S.encode([(bytes([k]), b"v" * 50) for k in range(100)], block_size=256))
    with pytest.raises(Corrupt):
        opened(data[:-1])
    bad = bytearray(data)
    bad[10] ^= 1
    with pytest.raises(Corrupt):
        list(opened(bytes(bad)).scan())
    with pytest.raises(ValueError):
        list(S.encode([(b"b", b""), (b"a", b"")]))
    assert S.between(b"the quick", b"the who") == b"the r" and S.between(b"\xff\xff", None) == b"\xff\xff" and S.between(b"ab", None) == b"b"
    for a, b in [(0, 0), (5, 300), (70000, 3), (2**32 - 1, 2**31)]:
        assert S.read_pair(S.pair(a, b), 0)[:2] == (a, b)


def test_data_source(spark, tmp_path):
    S.register(spark)
    df = spark.range(2000).select(F.col("id"), F.concat(F.lit("v"), F.col("id")).cast("binary").alias("value"))
    keyed = tables.rekey(df, tables.ordered_key(F.col("id") - 1000), 3).select("key", "value")
    keyed.write.format("sst").mode("overwrite").save(f"{tmp_path}/t")
    back = spark.read.format("sst").load(f"{tmp_path}/t")
    assert [bytes(r.value) for r in back.orderBy("key").collect()] == [b"v%d" % k for k in range(2000)]
    low = tables.ordered_key(F.lit(500)).alias("k")
    key = bytes(spark.range(1).select(low).first().k)
    assert back.where(F.col("key") >= F.lit(key)).count() == 500
    assert back.where(F.col("key") == F.lit(key)).count() == 1
