import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from texts (doc_id from 1 on), with a null row, extra columns and odd names."""

    def build(texts, extra=True):
        rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts, 1)]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if extra:
            for name in ("words", "key", "of", "cell", "digest", "ids", "listed", "cut", "n", "a", "b"):
                df = df.withColumn(name, F.lit(name))
        return df

    return build
