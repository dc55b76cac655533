import pytest
from pyspark.sql import functions as F

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# Null and empty values, repeated rows, ties, long and odd texts.
ODD_TEXTS = [
    None, "", " \t\n", "a", "A", "one two", "one two three", "One TWO three", "one two three four",
    "x" * 70_000, "word " * 30_000, "é" * 5000, "日本語 текст 🙂 mixed", "!!! ??? ...", "\x00\x01 zero", "tail\n",
]


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session

    s = build_session("local[4]", app="tessera-llm-tests", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (None, "one two three", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    # extra columns whose names clash with those that the operators make
    for name in ("row", "hash", "fp", "ids", "n", "score", "words", "component_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


def crc_remainder(x, m):
    import zlib

    return zlib.crc32(str(x).encode()) % m
