"""Tables written between steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
SMALL = 100_000


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one only where Spark is one local JVM and names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/poses-{uuid.uuid4().hex}"


def saved(rows: DataFrame) -> DataFrame:
    """``rows``, written and read again."""
    path = scratch(rows.sparkSession)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small(rows: DataFrame) -> DataFrame:
    """``rows`` to be broadcast, if there are few; to be joined by a shuffle, if not. Rows must be of a bounded size."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows
