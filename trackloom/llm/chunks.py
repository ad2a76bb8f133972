"""Documents as chunks of token numbers, and a packed question-and-answer exchange.

Corpus statistics about every token or window would need a shuffled row per token. Here a
task turns the documents that it reads into chunks of about a million tokens. For each key
that a chunk holds, however often, one packed entry goes to the bucket that owns the key;
the bucket answers every chunk in the order in which it asked. Both sides are grouped by
Spark. A chunk has a bounded size. Buckets are as many as the tokens ask for, about a million entries to each; a key
costs its bucket one entry for each chunk that holds it, however many rows do, so a bucket of common keys has an entry
more for each chunk: with 500,000 tokens a chunk, ten million for 10 TB of text.

The chunk table is written to the shared workspace, bucketed by chunk, before anything is
asked: every later pass reads the same chunks, whatever tasks or executors were lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, pack, record_batch, shuffle_partitions, unpack

CHUNK = (
    "chunk long, n_docs long, n_tokens long, doc_ids binary, lens binary, tokens binary, "
    "vocab_hash binary, vocab_words binary"
)
#: Stands for a null doc_id inside packed arrays; sorts first, as nulls do in Spark.
NULL_ID = np.iinfo(np.int64).min
#: Tokens in a chunk, more or less; bounds the memory of a task.
CHUNK_TOKENS = 1_000_000


def chunk_table(
    docs: DataFrame, space: Workspace, *, lower: bool, end: bool, words: bool, tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """Chunks of ``docs`` (doc_id, text): per document its id and length, then all token numbers.

    Tokens are the words between ASCII white space. ``lower`` lower-cases A-Z first, ``end``
    adds the token number 0 after each document, ``words`` keeps the vocabulary's bytes.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        ids, lens, parts, size = [], [], [], 0
        vocab: dict = defaultdict(count(1).__next__)

        def row() -> pa.RecordBatch:
            every = list(vocab)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in every), np.uint64, len(every))
            return record_batch(
                {
                    "chunk": [(part << 32) | serial],
                    "n_docs": [len(ids)],
                    "n_tokens": [size],
                    "doc_ids": [np.array(ids, np.int64).tobytes()],
                    "lens": [np.array(lens, np.int32).tobytes()],
                    "tokens": [np.concatenate([*parts, np.empty(0, np.int32)]).astype(np.int32).tobytes()],
                    "vocab_hash": [hashes.tobytes()],
                    "vocab_words": [b" ".join(every) if words else b""],
                },
                CHUNK,
            )

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                data = (text or "").encode()
                found = (data.lower() if lower else data).split()
                n = len(found) + end
                numbers = np.zeros(n, np.int32)
                numbers[: len(found)] = np.fromiter(map(vocab.__getitem__, found), np.int32, len(found))
                ids.append(NULL_ID if doc_id is None else doc_id)
                lens.append(n)
                parts.append(numbers)
                size += n
                if size >= tokens:
                    yield row()
                    serial += 1
                    ids, lens, parts, size = [], [], [], 0
                    vocab = defaultdict(count(1).__next__)
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(chunks, CHUNK)
    return space.save_bucketed(rows, "chunks", "chunk", max(8, shuffle_partitions(docs.sparkSession)))


class Chunk:
    """One row of the chunk table, as arrays."""

    def __init__(self, row):
        self.id = row["chunk"]
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.lens = np.frombuffer(row["lens"], np.int32).astype(np.int64)
        self.tokens = np.frombuffer(row["tokens"], np.int32)
        self.hashes = np.frombuffer(row["vocab_hash"], np.uint64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.row = row

    def words(self) -> list[bytes]:
        return [b"", *bytes(self.row["vocab_words"]).split(b" ")]


def per_chunk(chunks: DataFrame, answers: list[DataFrame], f: Callable, schema: str) -> DataFrame:
    """``f(chunk, answers)`` for each chunk; yields columns of ``schema``.

    ``answers``: for each table (chunk, bucket, payload), the unpacked payloads in the order of
    their buckets. Only the answers are shuffled; the chunk table is already bucketed.
    """
    joined, names = chunks, []
    for k, a in enumerate(answers):
        names.append(f"a{k}")
        joined = joined.join(
            a.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "payload"))).alias(f"a{k}")),
            "chunk",
            "left",
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                got = [[unpack(x["payload"]) for x in row[n] or []] for n in names]
                for out in f(Chunk(row), got):
                    yield record_batch(out, schema)

    return joined.mapInArrow(run, schema)


QUESTION = "chunk long, bucket int, payload binary"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of uniform 64-bit keys: equal ranges, so sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def questions(chunk: int, bucket: np.ndarray, *columns: np.ndarray) -> dict:
    """Rows for entries that are sorted by ``bucket``: each bucket's part of every column."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(bucket))
    return {
        "chunk": [chunk] * len(at),
        "bucket": [int(bucket[i]) for i in at],
        "payload": [pack(*(c[i:j] for c in columns)) for i, j in zip(at, ends)],
    }


def per_bucket(asked: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f(bucket, chunk ids, unpacked payloads)`` once for each bucket; returns a frame."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        return f(int(key[0]), group["chunk"].tolist(), [unpack(x) for x in group["payload"]])

    return asked.groupBy("bucket").applyInPandas(run, schema)


def n_buckets(chunks: DataFrame, entries: int = 1_000_000) -> int:
    """Buckets for questions about ``chunks``: about a million tokens, or less, to each."""
    total = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    return max(2 * shuffle_partitions(chunks.sparkSession), -(-int(total) // entries))
