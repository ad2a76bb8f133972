"""Ranked lexical search over bags: documents that no item can tell apart are scored once.

An item's score of a document depends on the counts of the items' own terms and on the length norm
m alone. So documents are restricted to the items' vocabulary, and those with the same vector of
counts and the same m are one class: found by a hash, verified by grouping and joining on the
vectors themselves. Each class is scored once, against the postings of the items, and the best
classes of an item are expanded to their members by ascending doc_id.

A class ahead of another by (score, least doc_id) has a document ahead of all of the other's, so
the best ``k`` documents lie in the best ``k`` classes, and only a class's ``k`` least members can
count: whatever the corpus, a task keeps ``k`` classes an item. Items come in groups of a bounded
number and size, drawn by a hash; a group's vocabulary and postings are what is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Workspace, bounded, record_batch, slices, table

TOP = 50
#: A group's items and the bytes of their terms, about (an item of more is a group of its own size).
ITEMS = 2048
ITEM_BYTES = 16_000_000
#: Cells of the table of scores, and postings, that a task looks at together.
CELLS = 1 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same in UTF-8, where all bytes of other letters are above 0x7F, after A-Z are lowered.
BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
LAST = np.iinfo(np.int64).max


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): distinct terms of all rows of an item, sorted; items without terms are left out."""
    lowered = F.translate(F.coalesce("text", F.lit("")), ASCII_UPPER, ASCII_LOWER)
    terms = items.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def groups(items: DataFrame) -> list[DataFrame]:
    """Parts of ``item_terms``, each of about ``ITEMS`` items and ``ITEM_BYTES`` bytes at most."""
    size = F.sum(F.octet_length(F.concat_ws(" ", "terms"))).alias("bytes")
    whole = items.agg(F.count("*").alias("n"), size).first()
    n = max(math.ceil(whole["n"] / ITEMS), math.ceil((whole["bytes"] or 0) / ITEM_BYTES))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


class Postings:
    """A group's vocabulary, its items' numbers by term, and the terms' weights once they are known."""

    def __init__(self, terms: list[list[str]]):
        self.number = {t: i for i, t in enumerate(sorted(set(chain.from_iterable(terms))))}
        pairs = np.array([(self.number[t], i) for i, ts in enumerate(terms) for t in ts], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.items, self.n_items = pairs[:, 1], len(terms)
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.number) + 1))
        self.weights = np.zeros(len(self.number), np.int64)

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        for term, n in df.items():
            self.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))

    def scores(self, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """A row for each class, a column for each item."""
        row = np.repeat(np.arange(len(m)), sizes)
        parts = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[row]))
        n = self.starts[terms + 1] - self.starts[terms]
        posting = np.repeat(self.starts[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.zeros(len(m) * self.n_items, np.int64)
        np.add.at(out, np.repeat(row, n) * self.n_items + self.items[posting], np.repeat(parts, n))
        return out.reshape(len(m), self.n_items)


class Best:
    """The ``k`` best classes of each item so far, by descending score, then least doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.held, self.waiting, self.n = np.empty((4, 0), np.int64), [], 0

    def add(self, scores: np.ndarray, classes: np.ndarray, docs: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        self.waiting.append(np.stack([item, scores[row, item], docs[row], classes[row]]))
        self.n += len(row)
        if self.n > max(4 * self.k * len(self.least), 1 << 16):
            self.prune()

    def prune(self) -> np.ndarray:
        rows = np.concatenate([self.held, *self.waiting], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        last = rows[:, place == self.k - 1]
        self.least[last[0]] = last[1]
        self.held, self.waiting, self.n = rows[:, place < self.k], [], 0
        return self.held


def restricted(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and counts of those that ``number`` has."""
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for t, i in number.items()})

    def run(batches):
        known = shared.value
        for b in slices(batches, 1000):
            rows = []
            for text in b["text"]:
                counts = Counter(BYTES.findall((text.as_py() or b"").lower()))
                rows.append((counts.total(), sorted((known[t], c) for t, c in counts.items() if t in known)))
            columns = {"n": [n for n, _ in rows], "terms": [[t for t, _ in v] for _, v in rows], "tfs": [[c for _, c in v] for _, v in rows]}
            yield record_batch({"doc_id": b["doc_id"].cast(pa.int64()), **columns}, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def best_classes(classes: DataFrame, postings: Postings, k: int) -> DataFrame:
    """(item, class, score): the ``k`` best classes of each item, by partial results of the tasks."""
    schema = "item long, score long, least long, class long"
    shared = classes.sparkSession.sparkContext.broadcast(postings)

    def run(batches):
        p = shared.value
        best = Best(p.n_items, k)
        for b in slices(batches, max(1, CELLS // max(p.n_items, 256))):
            sizes = b["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, tfs = (b[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            found = p.scores(b["m"].to_numpy(), sizes, terms, tfs)
            best.add(found, b["class"].to_numpy(), b["least"].fill_null(LAST).to_numpy())
        yield record_batch(dict(zip(("item", "score", "least", "class"), best.prune(), strict=True)), schema)

    found = classes.select("class", "m", "terms", "tfs", "least").mapInArrow(run, schema)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "least", "class"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("item", "class", "score")


def _search(docs: DataFrame, items: DataFrame, k: int, space: Workspace, name: str) -> DataFrame:
    spark = docs.sparkSession
    rows = items.toArrow()
    ids, postings = rows["item_id"].to_pylist(), Postings(rows["terms"].to_pylist())
    held = space.save(restricted(docs, postings.number), f"{name}/documents")
    whole = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    postings.weigh(whole["docs"], {r["term"]: r["n"] for r in df.collect()})  # no more terms than the group's
    length = F.expr(f"50 + (50 * n * {whole['docs']}L) div {whole['terms'] or 1}L").alias("m")
    vectors = held.where(F.size("terms") > 0).select("doc_id", length, "terms", "tfs")
    vectors = vectors.select("doc_id", F.xxhash64("m", "terms", "tfs").alias("h"), "m", "terms", "tfs")
    classes = vectors.groupBy("h", "m", "terms", "tfs").agg(F.min("doc_id").alias("least"))
    classes = space.save(classes.select(F.monotonically_increasing_id().alias("class"), "*"), f"{name}/classes")
    winners = space.save(best_classes(classes, postings, k), f"{name}/winners")
    few, _ = bounded(winners.select("class").distinct())
    won, _ = bounded(classes.join(few, "class").drop("least"), 8 * F.size("terms") + 64)
    members = vectors.join(won, ["h", "m", "terms", "tfs"]).select("class", "doc_id")
    by_doc = F.col("doc_id").asc_nulls_last()
    members = members.withColumn("nth", F.row_number().over(W.partitionBy("class").orderBy(by_doc))).where(F.col("nth") <= k).drop("nth")
    ranked = winners.join(members, "class").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), by_doc)))
    kind = items.schema["item_id"].dataType
    named = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind.simpleString()}")
    return ranked.where(F.col("rank") <= k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` documents of the highest scores above 0 for each item: (item_id, rank, doc_id, score).

    Takes docs (doc_id, text) and items (item_id, text); other columns, whatever their names, are ignored. Equal scores rank by
    ascending doc_id, a null doc_id last. A null or empty text has no terms: such a document is never found and not counted, such an
    item finds nothing. Rows that share a doc_id are documents of their own; rows that share an item_id, null too, are one item of all
    their terms. Long texts count whole. Empty tables give no rows.
    """
    if k < 1:
        raise ValueError("k has to be 1 or more")
    space = Workspace(docs.sparkSession, "search")
    found = space.save(item_terms(items), "items")
    parts = [_search(docs, part, k, space, f"group{i}") for i, part in enumerate(groups(found)) if not part.isEmpty()]
    kind = items.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in parts:
        out = out.unionByName(part)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tot AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), tot),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM tf JOIN wt USING (term) JOIN i USING (term), tot GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
