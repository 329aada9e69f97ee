import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows; the other columns are null."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, len(t) if t is not None else None) for i, t in rows], DOCS)

    return make


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


#: Rows that every operator must take: nulls, empty and blank texts, ties, repeated rows, a very long text.
def odd_rows():
    long = " ".join(f"word{i % 977} the of" for i in range(30000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (None, "nameless text of the house"), (6, long), (7, "é漢字 😀 <|endoftext|> a@b.co"), (8, "x" * 500)]
