import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """A documents table of (doc_id, text) with columns whose names clash with inner ones."""
    full = [(i, t, "en", "s", 0, 7, "x") for i, t in rows]
    return spark.createDataFrame(full, DOCS + ", chunk long, bucket string").repartition(3)
