import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     T.StructField("score", T.StringType()), T.StructField("digest", T.StringType())])

#: Nulls in any column, empty and blank texts, repeated rows and ids, a very long text, signs and scripts of all kinds, names that clash.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 59, "x", "y"), (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s", 59, "x", "y"), (2, None, None, None, None, None, None),
    (3, "", "en", "s", 0, None, ""), (None, "no id here but words there are, a few of them", None, "s", 1, "x", "y"), (None, None, "de", None, None, None, None), (4, " \t\n ", "en", "s", 4, "", ""), (5, "word " * 40_000, "en", "s", 200_000, "x", "y"),
    (6, "日本語のテキスト 😀 é ▁ <|endoftext|> <s>", "ja", "s", 9, "x", "y"), (7, "12345 !!! ###", "xx", "s", 13, "x", "y"), (8, "a", "en", "s", 1, "x", "y"), (8, "b c", "en", "s", 3, "x", "y"), (9, "a  b\n\n c\x0bd e \x1f f", "en", "s", 20, "x", "y"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
