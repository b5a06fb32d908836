"""Columns that functions take or make are computed once, however often a function needs them."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N

MADE = {
    "norm": lambda v: N.norm(v), "normalized": lambda v: N.normalized(v), "cross": lambda v: N.cross(v, F.reverse(v)), "angle": lambda v: N.vector_angle(v, F.reverse(v)), "largest": lambda v: N.largest_component(v),
    "ortho": lambda v: N.ortho(v), "shards": lambda v: N.shards_to_read(F.transform(v, lambda x: x > 0), 12),
}


@pytest.mark.parametrize("name", MADE)
def test_vectors_are_named_once(spark, name):
    """An argument stands at one place of the plan, and the gcd of shards too."""
    rows = spark.createDataFrame([([1.0, 2.0, -3.0],)], "v array<double>").select(MADE[name](F.col("v")).alias("made"))
    plan = rows._jdf.queryExecution().optimizedPlan().apply(0).expressions().toString()
    assert plan.count("v#") <= (2 if name in ("cross", "angle") else 1)
    assert plan.count("sequence(") + plan.count("sqrt(") + plan.count("array_max(") + plan.count("SQRT(") <= 3


def test_shards_and_right_angles(spark):
    r = spark.createDataFrame([([True, False, False, False, False, True],), ([False] * 6,), (None,)], "w array<boolean>").select(N.shards_to_read(F.col("w"), 4).alias("x")).collect()
    assert [x.x for x in r] == [[True, True, True, True], [False] * 4, [None] * 4]
    for v in ([3.0, 0.0, 4.0], [0.0, 0.0, 0.0], [1.0, -2.0, 2.0], [0.0, -5.0, 1.0]):
        o = spark.createDataFrame([(v,)], "v array<double>").select(N.ortho(F.col("v")).alias("o")).first().o
        assert abs(sum(x * y for x, y in zip(o, v))) < 1e-12 and (abs(sum(x * x for x in o) - 1) < 1e-12 or not any(v))
