import pytest
from pyspark.sql import types as T

LONG = "word " * 30_000

#: Every dealt operator meets these rows: nulls, empty and blank texts, a very long text and word, repeated rows and
#: ids, ties, and columns whose names operators use themselves.
EDGE_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 5, "x"),
    (3, None, "en", None, None, None),
    (4, "", None, "b", 0, None),
    (5, " \t\n ", "en", "b", 0, "y"),
    (6, LONG, "en", "a", 1, "y"),
    (7, "x" * 60_000, "en", "a", 1, "y"),
    (None, "a row without an id", "en", "a", 1, "y"),
    (8, "the  quick brown\tfox jumps over the lazy dog again and again", "en", "a", 1, "y"),
    (9, "Größe ñandú 日本語 😀 line\nline\nline two", "de", "c", 1, "y"),
]
EDGE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType())])


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with an extra column named like the operators' own id."""
    return spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
