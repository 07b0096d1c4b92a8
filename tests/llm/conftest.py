import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (or (doc_id, text) pairs)."""

    def make(texts, partitions=3):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        rows = spark.sparkContext.parallelize([(i, t, "en", "s", None) for i, t in rows], partitions)
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) of the smallest shared table."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    return sorted(zip(t["doc_id"], t["text"], strict=True))
