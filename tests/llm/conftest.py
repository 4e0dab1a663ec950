import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, sid string, words string, spans string, text_hash string, rep string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts: ids 1, 2, ...; sources in turn, one of them null; columns whose names clash with those used inside."""

    def make(texts, ids=None):
        rows = [((ids[i] if ids else i + 1), t, None, [None, "b", "a"][i % 3], None, "x", "y", "z", "v", "u", "t", "s") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
