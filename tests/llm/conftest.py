import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.IntegerType()),
    # names that the operators use themselves
    T.StructField("k", T.StringType()), T.StructField("m", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("copies", T.StringType()), T.StructField("_gw_fact", T.StringType()), T.StructField("_gw_mark", T.LongType()),
])


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text, lang, source) as documents with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), None, "k", 7, 8, "c", "f", 9) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, repeated rows and keys."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (None, "a null key here", "en", None), (3, long, "en", "b"),
        (4, "same row twice\nand its second line", "en", "b"), (4, "same row twice\nand its second line", "en", "b"),
        (5, "same key", "de", "a"), (5, "another text of the same key", "de", "a"), (6, " \t\n ", None, "a"),
        (7, "naïve über \U0001F600 text", "de", "a"),
    ]
