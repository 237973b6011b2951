import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.StringType()), T.StructField("score", T.StringType()), T.StructField("node", T.StringType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, with extra columns whose names the operators use themselves."""

    def build(rows):
        return spark.createDataFrame([(*r, *([None] * (4 - len(r))), len(r[1] or ""), "x", None, "y") for r in rows], DOCS)

    return build


LONG = "word " * 40_000
AWKWARD = [(1, None), (2, ""), (3, "   \n\t "), (4, "!!! ### ..."), (5, "é"), (None, "no id here at all"), (6, "same text, twice over"), (6, "same text, twice over"), (7, "same text, twice over"), (8, LONG), (9, "\x00nul   odd 🙂 characters")]
