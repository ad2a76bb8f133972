"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions only.

A window (ten words of an item, or a whole shorter item) is contained in a document only if all
of its words are, so one word of it must join: the necessary prefix at full containment. Words
are ordered by their frequency in the documents, counted over all of them, and each window's
prefix is its rarest word. A document word that equals a prefix fixes where the window would
start; the positional bound (it starts in the document) and the length bound (it ends there)
come first, then the words of the document's window are compared with the item's, one by one.

Documents' words are exploded within a stage; only verified hits are shuffled. Benchmark windows
are broadcast while their rows and bytes are within the limits of ``common.bounded``, checked each time; above, the join
is an ordinary one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, bounded, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct (gram, item_id): the word sequences of the windows and the items that hold them."""
    w = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    grams = w.select("item_id", "w", F.explode(starts).alias("s"))
    return grams.select(F.expr(f"slice(w, s, {window})").alias("gram"), "item_id").distinct()


def _bytes(gram: str) -> Column:
    """Of an array of words; a word may be of any length."""
    return F.octet_length(F.concat_ws(" ", gram)) + 32 * F.size(gram)


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each distinct window with its rarest word and that word's first place in it.

    A word that most windows hold would send them all to one task, so the counts go to the windows where the vocabulary may be broadcast.
    """
    grams = windows.select("gram").distinct()
    vocabulary, small = bounded(grams.select(F.explode("gram").alias("word")).distinct(), F.octet_length("word"))
    counts = (
        docs.select(F.explode(words("text")).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    )
    counts = F.broadcast(counts) if small else counts  # no more words than the vocabulary's
    placed = grams.select("gram", F.posexplode("gram").alias("at", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("rarest")
    return placed.groupBy("gram").agg(rarest).select("gram", F.col("rarest.word").alias("word"), F.col("rarest.at").alias("at"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """A row (doc_id, h, n_words) with null start for each document, and one for each verified hit."""
    found, small = bounded(prefixes(docs, windows), _bytes("gram"))
    held = docs.select("doc_id", F.xxhash64("text").alias("h"), words("text").alias("w"))
    wanted = found.select("word", "gram", "at")
    fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.size("gram") <= F.col("n_words"))
    start = (F.col("pos") - F.col("at")).alias("start")
    if small:
        # The last place, without a word, stands for the document itself. All in one stage: the
        # array of words is not copied, and looked at again only where a prefix joined.
        places = held.select(
            "doc_id", "h", "w", F.size("w").alias("n_words"), F.posexplode(F.expr("concat(w, array(cast(null AS string)))")).alias("pos", "word")
        )
        same = F.expr("slice(w, pos - at + 1, size(gram)) = gram")
        kept = places.join(wanted, "word", "left").where((F.col("pos") == F.col("n_words")) | (F.col("gram").isNotNull() & fits & same))
        return kept.select("doc_id", "h", "n_words", start, "gram")
    itself = held.select("doc_id", "h", F.size("w").alias("n_words"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("array<string>").alias("gram"))
    longest = windows.agg(F.max(F.size("gram"))).first()[0] or 1
    places = held.select("doc_id", "h", "w", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word")).select(
        "doc_id", "h", "n_words", "pos", "word", F.expr(f"slice(w, greatest(pos - {longest} + 2, 1), {2 * longest - 1})").alias("near")
    )
    same = F.expr(f"slice(near, pos - at + 1 - greatest(pos - {longest} + 1, 0), size(gram)) = gram")
    return itself.unionByName(places.join(wanted, "word").where(fits & same).select("doc_id", "h", "n_words", start, "gram"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of documents that lie in an occurrence of a window of a benchmark item.

    Takes docs (doc_id, text) and items (item_id, text); other columns are ignored. Returns doc_id, h
    (a hash of the text), n_words, n_hit, n_items, items_sha256, contaminated, items (item_ids) and
    hit_spans (start and length, in words), a row for each input row. Rows with the same doc_id and
    text get equal results; those with other texts have their own. A null text has no words and hits
    nothing; an item without words, or a null one, has no windows; an item with a null item_id marks
    words as hit but is not among the items. Empty tables are allowed.
    """
    windows = item_windows(items, window)
    found = hits(docs, windows)
    listed, _ = bounded(windows, _bytes("gram"))
    spans = F.collect_set(F.when(F.col("gram").isNotNull(), F.struct("start", F.size("gram").alias("n")))).alias("hit_spans")
    itself = F.sum(F.when(F.col("gram").isNull(), 1).otherwise(0)).alias("copies")
    rows = (
        found.join(listed, "gram", "left")
        .groupBy("doc_id", "h")
        .agg(F.max("n_words").cast("long").alias("n_words"), spans, F.collect_set("item_id").alias("items"), itself)
    )
    covered = F.expr("size(array_distinct(flatten(transform(hit_spans, x -> sequence(x.start, x.start + x.n - 1)))))")
    listed_ids = F.expr("array_join(array_sort(transform(items, x -> cast(x AS string))), ',')")
    rows = rows.select(
        "doc_id",
        "h",
        "n_words",
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed_ids, 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
        "items",
        "hit_spans",
        (F.col("copies") - 1).alias("more"),
        F.explode(F.expr("sequence(0, (copies - 1) div 65536)")).alias("high"),
    )
    # A row for each copy, by arrays of a bounded size.
    low = F.explode(F.expr("sequence(0, least(65535, more - high * 65536))")).alias("low")
    return rows.select("*", low).drop("more", "high", "low")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item.

    Rows that repeat stay or go together; rows that share a doc_id are judged by their own texts. Null and empty texts hold
    nothing and stay; long ones are looked at whole. Other columns, whatever their names, are kept as they are. Empty tables are allowed.
    """
    windows = item_windows(items, window)
    found = hits(docs, windows).where(F.col("gram").isNotNull()).select("doc_id", "h").distinct().alias("f")
    held = docs.alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.col("d.text")) == F.col("f.h"))
    return held.join(found, same, "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT doc_id, s, n, item_id FROM dw JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY 1),
its AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
