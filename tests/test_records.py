"""Messages made column by column, against those of each row."""

import random

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType

from tessera.sources import records

INNER = StructType().add("x", ArrayType(IntegerType())).add("y", StringType())
SCHEMA = StructType().add("a", IntegerType()).add("b", LongType()).add("c", BooleanType()).add("d", ArrayType(LongType())).add("e", ArrayType(DoubleType())).add("f", FloatType()).add("g", BinaryType()).add("h", StringType()).add("i", INNER).add("j", ArrayType(INNER))


def test_columns_make_the_messages_of_rows():
    r = random.Random(1)
    inner = lambda: r.choice([None, {"x": [-5, 7], "y": None}, {"x": None, "y": "q"}])
    rows = [{"a": r.choice([None, -1, 2**31 - 1, 5]), "b": r.choice([None, -(2**63), 300, 2**31]), "c": r.choice([None, True, False]), "d": r.choice([None, [], [1, -1, None, 2**40]]), "e": r.choice([None, [0.5, -1.0]]), "f": r.choice([None, 0.5]),
             "g": r.choice([None, b"", b"x" * 200]), "h": r.choice([None, "", "é" * 150]), "i": inner(), "j": r.choice([None, [], [inner() for _ in range(3)]])} for _ in range(500)]
    made = pa.array(rows, to_arrow_type(SCHEMA))
    whole = records.encoded_rows(made, SCHEMA)
    assert whole == [records.encode(x, SCHEMA) for x in rows] and records.encoded_rows(made.slice(7, 30), SCHEMA) == whole[7:37]
    for message, row in zip(map(records.decoder(SCHEMA), whole), rows):
        assert all(message[k] == row[k] for k in "abcfgh") and message["d"] == [x for x in row["d"] or [] if x is not None] and len(message["j"]) == sum(x is not None for x in row["j"] or [])
