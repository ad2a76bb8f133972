"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions has a nonzero vector of radius + 1 bits. A table belongs to each
nonzero vector v; its mask keeps the positions whose product with v is odd. For any ``radius``
positions some v is orthogonal to all their vectors, so in v's table the mask leaves these
positions out: two fingerprints that differ there, and nowhere else, have the same key. Every pair
within the radius collides, without probability.

The members of a bucket of up to ``PAIRS`` are compared with each other. In a larger one, pairs are never
listed: each member sends all its variants with up to radius / 2 of the
free bits turned; two members within the radius meet at a variant between them, and members that
meet are within the radius, so a link from each to the least one of the variant keeps exactly the
right components. Copies are one fingerprint from the start.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, record_batch, slices, table
from .components import components

BITS = 64
SEED = 42
RADIUS = 2
#: Members of a bucket that are compared with each other; more of them meet at variants, as exactly.
PAIRS = 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of the ``shingle``-word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, at = b" ".join(words), 0
    starts = []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[1:]] + [len(joined)]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[shingle - 1 :]) if len(words) >= shingle else [(0, len(joined))]
    return majority(np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed number."""
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 14):  # bounds the unpacked bits of long texts
        block = hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text)."""
    schema = "doc_id long, fp long"

    def run(batches):
        for b in slices(batches, 1000):
            fps = [fingerprint(t, shingle) for t in b["text"].to_pylist()]
            yield record_batch({"doc_id": b["doc_id"].cast(pa.int64()), "fp": fps}, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def masks(radius: int) -> list[int]:
    """The tables' bit masks, as signed numbers; each keeps about half of the bits or more."""
    if not 0 <= radius <= 5:
        raise ValueError("the radius has to be 0 to 5")
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(BITS)]
    out = []
    for v in range(1, 1 << radius + 1):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between fingerprints fp: each pair within an even ``radius`` is connected by them.

    ``distinct`` has each fingerprint once, none null; other columns are ignored. An empty table, or one of a single fingerprint, has no links.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius has to be even")
    every = masks(radius)
    rows = distinct.select("fp", F.posexplode(F.array(*(F.lit(m) for m in every))).alias("table", "mask"))
    rows = rows.select("table", F.expr("fp & mask").alias("key"), "fp")
    shared = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")

    def variants(mask: int):
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        turned = [sum(c) for r in range(radius // 2 + 1) for c in combinations(free, r)]
        return F.array(*(F.lit(t - (1 << 64) if t >> 63 else t) for t in turned))

    by_table = F.element_at(F.array(*map(variants, every)), F.col("table") + 1)
    member = rows.join(shared, ["table", "key"])
    few = member.where(F.col("n") <= PAIRS).select("table", "key", F.col("fp").alias("a"))
    others = few.withColumnRenamed("a", "b").withColumnsRenamed({"table": "table2", "key": "key2"})
    near = (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    few = few.join(others, (F.col("table") == F.col("table2")) & (F.col("key") == F.col("key2")) & near).select("a", "b")

    many = member.where(F.col("n") > PAIRS).select("table", "fp", F.explode(by_table).alias("turn"))
    many = many.select("table", F.expr("fp ^ turn").alias("variant"), "fp")
    # A variant's members and its least one: by partial aggregates, as a variant near a large
    # group of near copies may have thousands of members.
    least = many.groupBy("table", "variant").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most")
    many = many.join(least, ["table", "variant"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return few.unionByName(many).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """Components of documents linked at ``radius`` or fewer differing fingerprint bits.

    Takes (doc_id long, text string); other columns are ignored. Returns doc_id, fp (signed) and
    component_id, the smallest doc_id reachable, a row for each input row. A null text is empty; texts
    without words have fingerprint 0 and are linked as any others. Rows may share a doc_id: they are
    rows of their own, and links of either count for itself. Null doc_ids link too but are never the
    smallest, so component_id is null only where a component has no other. Empty tables give no rows.
    """
    space = Workspace(docs.sparkSession, "simhash")
    found = space.save(fingerprints(docs, shingle), "fingerprints")
    first = space.save(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(first.select("fp"), radius), space)
    of = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return found.join(of.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
