import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("id", T.StringType()), T.StructField("sig", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names operators use inside."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "x", "y") for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, wordless, very long and repeated texts."""
    return [None, "", "   \n\t ", "... !!! 12", "word " * 60_000, "é" * 50_000, "same text here", "same text here", "日本語のテキスト"]
