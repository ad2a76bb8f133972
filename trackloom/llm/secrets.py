r"""Secret scans: fixed patterns, and character Markov models for strings that no pattern names.

Two first-order Markov models over ``ALPHABET`` give the log-likelihood ratio of a string being random
rather than an ordinary identifier. They are trained on labelled samples (random boolean, word). By default the random ones
are drawn by a hash, as keys are made: base 64, base 62, hexadecimal, capitals and digits, of 20 to 63
characters; the ordinary ones are the corpus's own words of 6 letters or more that lie in no pattern's match, neighbours joined as identifiers are. A candidate is a maximal run of
20 or more letters of the alphabet that overlaps no pattern's match; it is a secret if the
log-likelihood ratio, in nats, is ``LEAST_RATIO`` or more.

The ordinary words come from a bounded sample: the texts with the ``SAMPLE`` smallest hashes of their
doc_id. Counts of letter pairs are grouped by Spark; the table of ratios has 67 x 67 numbers. All steps are DataFrame
functions. A text's spans are found in time about linear in it, however many it has: places are running sums by blocks, overlaps
a running maximum over sorted spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order in which they are listed. Matches under the least length are dropped.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As [0-9a-f]+ and AKIA[A-Z0-9]+ take the whole rest of a run, these find the same spans of the least length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
ORDINARY = r"[A-Za-z0-9+/=_-]{6,}"
SAMPLE = 2000
#: Random strings drawn for training.
RANDOM = 4000
#: Elements of an array, and characters of a text, that are looked at one by one.
BLOCK = 128
CUT = 2048
LEAST_RATIO = 12.0

SPAN = "struct<start:int,rank:int,stop:int,word:string>"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def running(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Of each number, ``of`` folded over those before it, from 0. By blocks, as an array that grows by one is copied each time."""

    def folded(block: Column, start: Column) -> Column:
        grown = F.aggregate(block, F.array(start), lambda acc, x: F.concat(acc, F.array(of(F.element_at(acc, -1), x))))
        return F.slice(grown, 1, F.size(block))

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda j: F.slice(v, j * BLOCK + 1, F.lit(BLOCK)))

        def joined(bs: Column) -> Column:
            totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), of))
            return F.flatten(F.transform(F.arrays_zip(bs.alias("b"), folded(totals, F.lit(0)).alias("s")), lambda z: folded(z["b"], z["s"])))

        return let(blocks, joined)

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, by_blocks))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def spans(pattern: str, rank: int, least: int = 0) -> Column:
    """Matches of ``pattern`` in text as (start, rank, stop, word), in code points; of group 2 ``least`` or longer."""
    found = F.regexp_extract_all(_text(), F.lit(pattern), F.lit(0))
    # What lies between the matches, and the matches' own lengths, add up to places.
    gaps = F.transform(F.split(_text(), pattern, -1), F.length)
    size = F.transform(F.regexp_extract_all(_text(), F.lit(pattern), F.lit(2)), F.length) if least else gaps

    def placed(x: Column) -> Column:
        before = running(F.transform(x, lambda p: p["gap"] + F.length(p["word"])), _sum)
        at = F.transform(F.arrays_zip(x.alias("x"), before.alias("b")), lambda z: F.struct((z["b"] + z["x"]["gap"]).alias("start"), z["x"]["word"].alias("word"), z["x"]["of"].alias("of")))
        kept = F.filter(at, lambda p: p["of"] >= least)
        return F.transform(kept, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), (p["start"] + F.length(p["word"])).alias("stop"), p["word"].alias("word")))

    # The last gap has no match after it.
    parts = F.filter(F.arrays_zip(found.alias("word"), gaps.alias("gap"), size.alias("of")), lambda x: x["word"].isNotNull())
    return F.when(_text().rlike(pattern), let(parts, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans() -> Column:
    return F.concat(spans(ASSIGN, 0, ASSIGN_LEAST), spans(ACCESS, 1), spans(HEX, 2))


def free(candidates: Column, known: Column) -> Column:
    """Those of ``candidates`` that overlap none of ``known``; the candidates themselves don't overlap.

    A known span overlaps one if it starts before the candidate's stop and ends after its start. In the order of starts,
    and of stops for candidates, the furthest end so far tells.
    """
    event = lambda at, known_, s: F.struct(at.alias("at"), F.lit(known_).alias("known"), s.alias("span"))
    both = F.concat(F.transform(candidates, lambda c: event(c["stop"], 0, c)), F.transform(known, lambda k: event(k["start"], 1, k)))

    def of(sorted_: Column) -> Column:
        furthest = running(F.transform(sorted_, lambda e: F.when(e["known"] == 1, e["span"]["stop"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        clear = F.filter(F.arrays_zip(sorted_.alias("e"), furthest.alias("f")), lambda z: (z["e"]["known"] == 0) & (z["f"] <= z["e"]["span"]["start"]))
        return F.transform(clear, lambda z: z["e"]["span"])

    return F.when(F.size(candidates) == 0, candidates).when(F.size(known) == 0, candidates).otherwise(let(F.array_sort(both), of))


def _smallest(docs: DataFrame) -> DataFrame:
    """The texts of the ``SAMPLE`` doc_ids of least hash: ids alone are sorted, and sent to the texts."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")


def random_strings(spark: SparkSession, n: int = RANDOM) -> DataFrame:
    """``n`` strings (word), the same ones each time."""
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id")), 512)
    long = F.base64(F.unhex(digest))
    capitals = F.upper(F.regexp_replace(long, "[^A-Za-z0-9]", ""))
    forms = F.array(long, F.regexp_replace(long, "[^A-Za-z0-9]", ""), digest, F.upper(digest), F.translate(F.translate(long, "+", "-"), "/", "_"), capitals)
    length = 20 + F.pmod(F.xxhash64("id"), F.lit(44)).cast("int")
    return spark.range(n).select(F.substring(F.element_at(forms, (F.col("id") % 6 + 1).cast("int")), F.lit(1), length).alias("word"))


def training_strings(docs: DataFrame) -> DataFrame:
    """Distinct (random boolean, word): drawn strings, and identifiers of the corpus's words outside the patterns' matches."""
    rest = _text()
    for p in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, p, " ")
    found = F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))
    pairs = F.arrays_zip(found.alias("a"), F.slice(found, 2, F.greatest(F.size(found), F.lit(1))).alias("b"))

    def joined(x: Column, i: Column) -> Column:
        forms = [F.concat(x["a"], F.lit("_"), x["b"]), F.concat(x["a"], F.initcap(x["b"])), F.concat(x["a"], F.lit("-"), x["b"]), F.concat(x["a"], F.lit("/"), x["b"])]
        return F.coalesce(F.element_at(F.array(*forms), i % 4 + 1), x["a"])

    words = _smallest(docs.select("doc_id", "text")).select(F.explode(F.transform(pairs, joined)).alias("word"))
    drawn = random_strings(docs.sparkSession).select(F.lit(True).alias("random"), "word")
    return drawn.unionByName(words.distinct().select(F.lit(False).alias("random"), "word"))


def fit(docs: DataFrame, labelled: DataFrame | None = None) -> list[float]:
    """Log ratio of each pair of letters, row by row; add-one smoothed, 0 without samples.

    ``labelled`` (random boolean, word) takes the place of ``training_strings``. Words with letters that aren't in ``ALPHABET``
    count by the pairs that are; nulls and words of one letter don't count.
    """
    word = F.col("word")
    letters = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))
    labelled = training_strings(docs) if labelled is None else labelled
    pairs = labelled.where("random IS NOT NULL").where(F.length(word) > 1).select("random", F.explode(letters).alias("pair"))
    # At most two rows for each of 67 x 67 pairs come to the driver.
    size = len(ALPHABET)
    pairs = pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/=_-]{2}$"))
    n = {True: [0] * size * size, False: [0] * size * size}
    for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect():
        n[r["random"]][ALPHABET.index(r["pair"][0]) * size + ALPHABET.index(r["pair"][1])] = r["n"]
    out = []
    for i in range(size):
        row = slice(i * size, (i + 1) * size)
        of = {k: sum(v[row]) + size for k, v in n.items()}
        out += [math.log((a + 1) / of[True]) - math.log((b + 1) / of[False]) for a, b in zip(n[True][row], n[False][row])]
    return out


def ratio(word: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a word of letters of ``ALPHABET``; 0 for one letter."""
    table_ = F.lit(model)
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(word, i, F.lit(1))) - 1
    pairs = F.sequence(F.lit(1), F.length(word) - 1)
    term = lambda acc, i: acc + F.element_at(table_, place(i) * len(ALPHABET) + place(i + 1) + 1)
    return F.when(F.length(word) < 2, 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), term))


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """The rows of ``docs`` with secrets, an array of spans (start, kind, stop) by start, then kind.

    Takes (doc_id, text); all columns stay, but for one named secrets, which is replaced. Places are code points, stop exclusive. A null or
    empty text has none. Rows are independent of each other, so repeated ones get equal results; long texts are scanned whole; an
    empty table gives no rows. Spans of several kinds may overlap. Without samples the ratios are 0 and only the patterns count.
    """
    model = fit(docs) if model is None else model
    names = F.array(*map(F.lit, KINDS))
    kind = lambda s: F.element_at(names, s["rank"] + 1)

    def all_spans(base: Column) -> Column:
        likely = F.filter(spans(CANDIDATE, 3), lambda s: ratio(s["word"], model) >= LEAST_RATIO)
        return F.array_sort(F.concat(base, F.when(_text().rlike(CANDIDATE), let(likely, lambda c: free(c, base))).otherwise(F.array().cast(f"array<{SPAN}>"))))

    named = F.transform(let(base_spans(), all_spans), lambda s: F.struct(s["start"].alias("start"), kind(s).alias("kind"), s["stop"].alias("stop")))
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "secrets"), named.alias("secrets"))


def listed(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(found: DataFrame, mark: str = "[secret]") -> Column:
    """The text of a scanned row with each secret, overlapping ones together, replaced by ``mark``.

    The text is cut into blocks of ``CUT`` characters first, so that a piece of it is found without counting from the text's start.
    """

    def piece(blocks: Column, start: Column, stop: Column) -> Column:
        """Characters from ``start`` to before ``stop``."""
        first, last = F.floor(start / CUT).cast("int"), F.floor(stop / CUT).cast("int")
        end = F.coalesce(F.substring(F.try_element_at(blocks, last + 1), F.lit(1), stop % CUT), F.lit(""))
        head = F.substring(F.element_at(blocks, first + 1), start % CUT + 1, F.lit(CUT))
        within = F.substring(F.element_at(blocks, first + 1), start % CUT + 1, stop - start)
        apart = F.concat(head, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), end)
        return F.when(start >= stop, "").when(first == last, within).otherwise(apart)

    def marked(x: Column) -> Column:
        blocks, secrets = x["blocks"], x["secrets"]
        done = running(F.transform(secrets, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
        parts = F.transform(
            F.arrays_zip(secrets.alias("s"), done.alias("d")),
            lambda z: F.when(z["s"]["start"] >= z["d"], F.concat(piece(blocks, z["d"], z["s"]["start"]), F.lit(mark))).otherwise(""),
        )
        return F.concat(F.array_join(parts, ""), piece(blocks, F.array_max(F.transform(secrets, lambda s: s["stop"])), x["n"]))

    blocks = F.regexp_extract_all(_text(), F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    whole = F.struct(blocks.alias("blocks"), F.col("secrets").alias("secrets"), F.length(_text()).alias("n"))
    return F.when(F.size("secrets") == 0, F.col("text")).otherwise(let(whole, marked))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
