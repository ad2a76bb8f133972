"""One text of each group of similar ones, by SimHash fingerprints and an exact join of shingle sets.

Texts are linked if their fingerprints are within a radius, which ``simhash`` finds by covering masks. What fingerprints don't link, as they lose many
similar pairs, is joined exactly: texts are linked, too, if their sets of word shingles have a Jaccard similarity of ``SIMILARITY`` or more. Such sets share a
shingle of their prefixes: the fifth of each set, and one more, that comes first in an order that all have in common. Sizes,
bitmaps and the number of shingles that two prefixes share rule out most of the texts that meet by chance; what is left is compared, set with set.

Groups are the components of the links. A large group's pairs are never listed: each text is first compared with one leader
of its shingles, and only texts that these links leave apart are compared further. The texts stay where they are: one pass
gives each distinct text's hash, size, bitmap and prefix, another the sets of the few texts that are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import simhash
from .common import Workspace, bounded, record_batch, slices
from .components import components

SEED = 42
#: Words of a fingerprint's shingles.
SIMHASH = 3
SIMILARITY = 0.8
#: Words of a set's bitmap.
MAPS = 8
#: Texts that the frequent shingles are found in, about, and the most of such shingles.
SAMPLE = 30_000
FREQUENT = 300_000
#: Texts looked at together.
ROWS = 200

MAP = [f"map{k}" for k in range(MAPS)]


def rank() -> Column:
    """The doc_id; a null one comes last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def node(found: list[bytes]) -> int:
    """A hash of the words: texts of the same words, A-Z in either case, are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(found), SEED)).view(np.int64))


def shingle_set(found: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the ``shingle``-word shingles; shorter texts are one shingle."""
    size, digest = min(shingle, len(found)), xxhash.xxh64_intdigest
    every = (b" ".join(found[i : i + size]) for i in range(len(found) - size + 1)) if found else ()
    return np.unique(np.fromiter((digest(x, SEED) for x in every), "<u8"))


def frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that recur most in a sample of the texts, and their ranks by frequency: the last in the order of prefixes.

    Any order keeps prefixes exact; one with frequent shingles last makes fewer candidates. At most ``FREQUENT`` come to the driver.
    """
    share = max(1, texts.count() // SAMPLE)

    def rows(batches):
        for b in slices(batches, ROWS):
            for t in b["text"].to_pylist():
                yield pa.record_batch([pa.array(shingle_set(words(t), shingle).view("<i8"))], names=["s"])

    sample = texts.where(F.pmod(F.xxhash64("rank"), F.lit(share)) == 0).select("text").mapInArrow(rows, "s long")
    found = sample.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow()
    keys = found["s"].to_numpy().astype("<i8").view("<u8")
    order = np.argsort(keys)
    return keys[order], len(keys) - order


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by their lowest bits: two sets differ in as many shingles as bits, or more."""
    odd = np.bincount((found % np.uint64(64 * MAPS)).astype(np.int64), minlength=64 * MAPS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(found: np.ndarray, keys: np.ndarray, ranks: np.ndarray, least: float) -> np.ndarray:
    if not len(found):
        return found
    late = np.zeros(len(found), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        late = np.where(keys[at] == found, ranks[at], 0)
    size = len(found) - int(np.ceil(len(found) * least - 1e-9)) + 1
    return found[np.lexsort((found, late))[:size]]


def distinct_texts(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(node, rank, fp, size, map0 .., prefix): each distinct text of (rank, text) with its least rank; fp is its ``simhash.fingerprint``."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(frequent(texts, shingle))  # at most FREQUENT numbers
    schema = "node long, rank long, fp long, size long, " + ", ".join(f"{m} long" for m in MAP)

    def run(batches):
        keys, ranks = shared.value
        for b in slices(batches, ROWS):
            found = [words(t) for t in b["text"].to_pylist()]
            fps = [simhash.fingerprint(t, SIMHASH) for t in b["text"].to_pylist()]
            sets = [shingle_set(w, shingle) for w in found]
            maps = np.array([bitmap(x) for x in sets], "<i8").reshape(-1, MAPS)
            columns = {"node": [node(w) for w in found], "rank": b["rank"], "fp": fps, "size": list(map(len, sets))}
            out = record_batch(columns | {m: maps[:, k] for k, m in enumerate(MAP)}, schema)
            firsts = [prefix(x, keys, ranks, least).view("<i8") for x in sets]
            yield out.append_column("prefix", pa.array(firsts, pa.list_(pa.int64())))

    rows = texts.mapInArrow(run, schema + ", prefix array<long>")
    return rows.groupBy("node").agg(F.min("rank").alias("rank"), *(F.first(c).alias(c) for c in ("fp", "size", *MAP, "prefix")))


def fingerprint_links(found: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the nodes of ``distinct_texts`` that connect all whose fingerprints are within ``radius`` bits.

    Nodes of one fingerprint are linked to the least of them, and the least ones of fingerprints as ``simhash.links`` links these.
    """
    first = found.groupBy("fp").agg(F.min("node").alias("least"))
    copies = found.select("node", "fp").join(first, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = simhash.links(first.select("fp"), radius)
    ends = [first.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node")) for c in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return copies.unionByName(near)


def postings(found: DataFrame) -> DataFrame:
    """(s, n, place, node, size, map0 ..): the shingles in the prefixes of ``distinct_texts`` that n > 1 prefixes hold, and their places there."""
    each = found.select(F.posexplode("prefix").alias("place", "s"), "node", "size", *MAP)
    return each.join(each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "s")


def _may_be_similar(least: float) -> Column:
    """Whether sizes, bitmaps and the places of one shared shingle of two rows, the second one's with _b, leave a similarity of ``least`` possible.

    Of what they share, at most as much as the smaller place comes before the shingle, and as much as the set that has less left after it.
    """
    rest = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) + F.least("place", "place_b")
    places = rest >= F.ceil((F.col("size") + F.col("size_b")) * (least / (1 + least)) - 1e-9)
    bits = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_b"))) for m in MAP[1:]), F.bit_count(F.col("map0").bitwiseXOR(F.col("map0_b"))))
    lengths = F.least("size", "size_b") >= F.greatest("size", "size_b") * least - 1e-9
    return lengths & places & (bits <= (F.col("size") + F.col("size_b")) * ((1 - least) / (1 + least)) + 1e-6)


def _shared_enough(least: float) -> Column:
    """Whether two prefixes share as many shingles, n, as a similarity of ``least`` takes.

    Such sets share least / (1 + least) of both sizes. Of the prefix that ends first in the common order, what is shared up to its end lies in
    both prefixes; past it, no more can be shared than that set has left.
    """
    left = F.greatest(*(F.ceil(F.col(c) * least - 1e-9) - 1 for c in ("size", "size_b")))
    return F.col("n") >= F.ceil((F.col("size") + F.col("size_b")) * (least / (1 + least)) - 1e-9) - left


def leading(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b): for each a the leader b of some of its shingles, the weightiest that shares enough of them.

    ``rows`` are postings. Weight is the number of texts met at all shingles, so that the middle of a group leads it.
    Each node has one pair at most, so large groups make no more of them than they have members.
    """
    weight = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = rows.join(weight, "node")
    columns = ("weight", "node", "size", "place", *MAP)
    lead = weighed.groupBy("s").agg(F.max(F.struct(*columns)).alias("lead"))
    lead = lead.select("s", *(F.col(f"lead.{c}").alias(f"{c}_b") for c in columns))
    led = rows.join(lead, "s").where((F.col("node") != F.col("node_b")) & _may_be_similar(least))
    led = led.groupBy("node", "node_b", "size", "size_b", "weight_b").agg(F.count("*").alias("n")).where(_shared_enough(least))
    return led.groupBy(F.col("node").alias("a")).agg(F.max_by("node_b", F.struct("weight_b", "node_b")).alias("b"))


def apart(rows: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that share enough shingles of their prefixes, may be similar, and that ``roots`` (node, root) doesn't connect yet."""
    known = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("s")
    known = known.join(mixed, "s")
    other = known.select("s", *(F.col(c).alias(f"{c}_b") for c in known.columns if c not in ("s", "n")))
    both = known.join(other, "s").where((F.col("node") > F.col("node_b")) & (F.col("root") != F.col("root_b")) & _may_be_similar(least))
    shared = both.groupBy("node", "node_b", "size", "size_b").agg(F.count("*").alias("n")).where(_shared_enough(least))
    return shared.select(F.col("node").alias("a"), F.col("node_b").alias("b"))


def named(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with ``column``, its text's node, in place of any column of that name."""
    schema = StructType([*(f for f in docs.schema if f.name != column), StructField(column, LongType())])

    def run(batches):
        for b in slices(batches, ROWS):
            b = b.drop_columns([column]) if column in b.schema.names else b
            yield b.append_column(column, pa.array([node(words(t)) for t in b["text"].to_pylist()], pa.int64()))

    return docs.mapInArrow(run, schema)


def similar(pairs: DataFrame, found: DataFrame, texts: DataFrame, shingle: int, least: float, space: Workspace, name: str) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets have a similarity of ``least`` or more.

    Only the texts of ``pairs`` are made sets of. They are found by the node and its least rank; up to
    a number of nodes that ``bounded`` checks, no text is shuffled for that.
    """
    pairs = space.save(pairs, f"pairs_{name}")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = space.save(found.select("node", "rank").join(ends, "node"), f"compared_{name}")

    def sets_of(batches):
        for b in slices(batches, ROWS):
            sets = [shingle_set(words(t), shingle).tobytes() for t in b["text"].to_pylist()]
            yield record_batch({"node": b["node"], "shingles": sets}, "node long, shingles binary")

    def compare(batches):
        for b in batches:
            kept = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(shared >= least * (len(x) + len(y) - shared))
            yield pa.record_batch([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    # The texts meet between the two Python steps, so that no task has a worker for each.
    held = named(texts, "node").join(bounded(wanted)[0], ["node", "rank"]).select("node", "text").dropDuplicates(["node"])
    sets = space.save(held.mapInArrow(sets_of, "node long, shingles binary"), f"sets_{name}")
    of = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    of = of.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = space.save(of.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), f"links_{name}")
    for used in ("pairs", "compared", "sets"):
        space.drop(f"{used}_{name}")
    return links


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = SIMILARITY, radius: int = simhash.RADIUS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first by doc_id in their group.

    Texts are linked if their SimHash fingerprints differ in ``radius`` or fewer bits, or if their sets of ``shingle``-word shingles have a Jaccard
    similarity of ``least`` or more; groups are the components of all links, so a text that goes still links others. No link is left out. No
    two rows that stay are linked, and each row that goes is joined by links to one that stays.

    Texts of the same words, A-Z in either case, are one node, by a 64-bit hash. Of repeated rows, or rows of one
    doc_id and node, one stays. Null texts are empty, and all texts without words are copies; a null doc_id
    comes last. Long texts count whole. A column node__ is replaced, other names don't matter. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession, "similar_texts")
    texts = docs.select(rank(), "text")
    found = space.save(distinct_texts(texts, shingle, least), "texts")
    near = space.save(fingerprint_links(found, radius), "near")
    rows = space.save(postings(found), "postings")
    led = near.unionByName(similar(leading(rows, least), found, texts, shingle, least, space, "led"))
    roots = space.save(components(led, Workspace(docs.sparkSession, "led")), "led_roots")
    rest = similar(apart(rows, roots, least), found, texts, shingle, least, space, "apart")
    space.drop("postings")
    roots = components(led.unionByName(rest), space).withColumnRenamed("node", "of")
    rooted = found.select("node", "rank").join(roots, F.col("node") == F.col("of"), "left").select(F.coalesce("root", "node").alias("root"), "rank", "node")
    first = space.save(rooted.groupBy("root").agg(F.min(F.struct("rank", "node")).alias("k")).select("k.rank", "k.node"), "first")
    space.drop("texts")
    kept = named(docs, "node__")
    return kept.join(first, (rank() == first["rank"]) & (F.col("node__") == first["node"]), "left_semi").dropDuplicates(["doc_id", "node__"]).drop("node__")
