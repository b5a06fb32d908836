import itertools
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from tessera.plans.plang import PlangError, compile_where, parse, where

PHONE = T.StructType([T.StructField("number", T.StringType()), T.StructField("type", T.StringType(), True, {"enum": {"MOBILE": 0, "HOME": 1, "WORK": 2}, "default": "HOME"})])
PERSON = T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.LongType()), T.StructField("email", T.StringType()), T.StructField("phone", T.ArrayType(PHONE)),
                       T.StructField("big", T.DecimalType(20, 0)), T.StructField("ok", T.BooleanType()), T.StructField("account", T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("street", T.StringType())]))])


@pytest.fixture(scope="module")
def people(spark):
    rows = [("Roman", 6, None, [Row("1", None), Row("2", "WORK"), Row("3", "MOBILE")], Decimal(2**63 + 5), True, Row([1, 2], None)), ("Anna", 9, "a@b", [], Decimal(1), False, None), (None, None, None, None, None, None, Row(None, "x"))]
    return spark.createDataFrame(rows, PERSON)


@pytest.mark.parametrize("text, names", [
    ("id < 7", ["Roman", None]), ("id > 5", ["Roman", "Anna"]), ("not id > 6", ["Roman", None]), ("id != 5", ["Roman", "Anna", None]), ("(id=6) or name='Anna'", ["Roman", "Anna"]),
    ("phone.number = '3'", ["Roman"]), ("phone.number = '4'", []), ("phone.number != '3'", ["Anna", None]), ("phone.type = 1", ["Roman"]), ("phone.type = 'WORK'", ["Roman"]),
    ("def(account.street)", [None]), ("def(phone)", ["Roman"]), ("not def(phone.type)", ["Anna", None]), ("def(phone.number) or id = 9", ["Roman", "Anna"]), ("ok = true", ["Roman"]), ("ok = 0", ["Anna", None]),
    ("big > 9223372036854775807", ["Roman"]), ("account.ids = 2", ["Roman"]), ("account.ids < id", ["Roman"]), ("name = ''", [None]), ("not name = 'Anna' and id = 6", ["Roman", "Anna", None]), ("", ["Roman", "Anna", None]),
])
def test_rows(people, text, names):
    assert sorted(map(str, [r.name for r in where(people, text).collect()])) == sorted(map(str, names))


@pytest.mark.parametrize("text", ["name < 'a'", "name = 3", "id = 'x'", "nope = 1", "f(id) = 1", "id =", "id = 1 and", "(id = 1", "id ~ 3", "phone.type < 2"])
def test_errors(people, text):
    with pytest.raises(PlangError):
        compile_where(text, people.schema)


def test_precedence():
    t = parse("a = 1 or b = 2 and c = 3")
    assert t.kind == "AND" and t.args[0].kind == "OR"
    t = parse("not a = 1 and b = 2")
    assert t.kind == "NOT" and t.args[0].kind == "AND"
    assert parse(r"a = 'it\'s'").args[1].value == r"it\'s"


def test_against_plain_python(spark):
    rows = [(i, [x for x in range(4) if i >> x & 1]) for i in range(16)]
    df = spark.createDataFrame(rows, "id long, xs array<long>")
    for sign, k in itertools.product(("=", "!=", "<", "<=", ">", ">="), (1, 2)):
        f = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        want = {i for i, xs in rows if (not any(x == k for x in xs) if sign == "!=" else any(f[sign](x, k) for x in xs))}
        assert {r.id for r in where(df, f"xs {sign} {k}").collect()} == want, (sign, k)
