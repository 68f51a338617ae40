import pytest
from pyspark.sql import types as T

from .helpers import prose

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names the operators use inside, as extra input columns.
CLASH = ["t", "key", "row", "fp", "body", "line_no", "word", "gram", "part", "base", "spans", "score", "node", "n", "train", "ids"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None) for i, t in rows], DOCS)
        if clash:
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit("x") for c in CLASH})
        return df
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank, repeated, tied, very long, non-ASCII texts; null and repeated ids."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "Hello World again"), (4, "Hello World again"), (5, "hello   world AGAIN"), (6, long), (7, long + " tail"),
            (8, "Ünïcode wörds ΑΒΓ 漢字 \U0001f600 end"), (None, "an orphan text of some words"), (None, None), (9, "one"), (10, prose(2, 200)), (11, prose(2, 200)),
            (12, "\n".join([prose(3, 30), prose(4, 30), prose(3, 30)])), (4, "the same id, other text")]
