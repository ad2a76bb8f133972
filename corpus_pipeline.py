"""A training corpus in five stages, each written and read again as the next one's documents.

Toxic documents go; of each group of near-duplicates, which SimHash fingerprints or the shingle sets link, the document with
the smallest doc_id stays; documents that hold a passage of the benchmark go; secrets are replaced by a mark; what is left
is encoded in pieces with merge-dropout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, pieces, secrets, simhash, similar_texts, toxicity
from trackloom.llm.common import Workspace, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar_texts.one_of_each(docs, radius=simhash.RADIUS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs)
    clean = found.withColumn("text", secrets.redact(found))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("pieces", encoded),
]

#: DuckDB can't express the stages' models and hashes; tests/llm hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, space = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
