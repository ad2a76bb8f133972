"""Shared helpers of the text operators: tables, the shared workspace, packed columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What may be broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32_000_000
#: The most keys that are called hot.
HOT = 1024
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A folder of written tables below ``spark.checkpoint.dir``.

    Operators cut lineage by writing a table here and reading it back, so a lost
    executor costs only its running tasks. Only where the setting is unset, and Spark
    runs in one local JVM (tests), a temporary folder takes its place.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        self.spark, self.path = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    @contextmanager
    def _cleaning(self) -> Iterator[None]:
        """A written table needs its shuffle files no more: they go when the write ends, not when the driver collects its garbage."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        with self._cleaning():
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Save so that later joins on ``key`` read this side without a shuffle."""
        full = f"t_{uuid.uuid4().hex}"
        with self._cleaning():
            df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(full)
        return self.spark.table(full)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(rows: DataFrame, found: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``rows`` left join ``found`` (``on``, ``n`` and one column more) where a key may hold a third of all rows.

    ``n`` is the rows of a key, ``total`` those of all: at most ``HOT`` keys have more than their share of ``total`` / ``HOT``, and
    these are broadcast. Rows of theirs, and rows with a null key, are dealt out by a hash of the whole row.
    """
    (value,) = (c for c in found.columns if c not in (*on, n))
    hot = found.where(F.col(n) > total / HOT).select(*on, F.col(value).alias("hot__"))
    cold = found.where(F.col(n) <= total / HOT).select(*on, value, F.lit(-1).alias("side__"))
    met = rows.join(F.broadcast(hot), on, "left")
    away = F.col("hot__").isNotNull() | F.array_contains(F.array(*(F.col(c).isNull() for c in on)), True)
    met = met.withColumn("side__", F.when(away, F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int")).otherwise(-1))
    out = met.join(cold, [*on, "side__"], "left")
    return out.select(*rows.columns, F.coalesce("hot__", value).alias(value))


ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def record_batch(columns: dict, schema: str) -> pa.RecordBatch:
    """Lists or arrays by name as an Arrow batch of a Spark schema like ``a long, b string``."""
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    return pa.record_batch([pa.array(columns[n], ARROW[t]) for n, t in fields], names=[n for n, _ in fields])


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows: what Python makes of a part is all that a task holds at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def bounded(df: DataFrame, size: Column | None = None) -> tuple[DataFrame, bool]:
    """``df``, to be broadcast if it is seen to be small, and whether it is: up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes.

    ``size`` gives a row's bytes; without it, rows must be of a bounded size. The check reads one row more than may be.
    """
    rows = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size if size is not None else F.lit(0)), F.lit(0)).alias("bytes")).first()
    small = rows["n"] <= BROADCAST_ROWS and rows["bytes"] <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), small


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pack(*arrays: np.ndarray) -> bytes:
    """Several integer or float arrays in one value, bytes of equal place together.

    The high bytes of small numbers are then runs of zeros, which Spark's shuffle
    compression removes.
    """
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(a.dtype.str.encode().ljust(8) + np.array([len(a)], np.int64).tobytes())
        out.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for _ in range(n):
        kind = np.dtype(bytes(data[at : at + 8]).decode().strip())
        size = int(np.frombuffer(data, np.int64, 1, at + 8)[0])
        planes = np.frombuffer(data, np.uint8, size * kind.itemsize, at + 16)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, size).T).view(kind).reshape(size))
        at += 16 + size * kind.itemsize
    return out
