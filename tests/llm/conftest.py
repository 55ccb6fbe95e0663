import os

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from passbook.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()), StructField("size", StringType()),
    StructField("fp", LongType()),
])


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 35, "x", 1),
        (2, "ALPHA beta gamma delta epsilon zeta", "en", "a", 35, "y", 2),
        (2, "ALPHA beta gamma delta epsilon zeta", "en", "a", 35, "y", 2),
        (3, None, None, None, None, None, None), (4, "", "en", "b", 0, "x", 1), (5, " \t\n", "en", "b", 3, "x", 1),
        (None, "one two", "en", None, 7, "x", 1), (6, "one two three", "de", "c", 13, "x", 1),
        (7, long, "en", "c", len(long), "x", 1), (8, long + " tail", "en", "d", len(long) + 5, "x", 1),
        (9, "x" * 200_000, "en", "d", 200_000, "x", 1), (10, "é ü ß Ä", "de", "d", 7, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
