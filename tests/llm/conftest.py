import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table from (doc_id, text) or longer tuples."""
    def make(rows):
        full = [(tuple(r) + (None, None, None, None))[:5] for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def stored(spark, tmp_path, docs_of):
    """A folder with tables as a query reads them."""
    def write(documents=None, **tables):
        if documents is not None:
            docs_of(documents).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write


def rows(df):
    return [tuple(r) for r in df.collect()]
