"""Quality rules in a short-circuit cascade.

A rule rejects a text by one or two measures of it; measures are computed when a rule first asks
for them, and kept. On a sample of documents each rule is applied to each text on its own and timed.
Rules then run in the order of their rejections per second, and a text leaves at its first
rejection. The order changes what is computed, never the verdict: a text is kept if no rule rejects it.

The sample are the documents with the ``SAMPLE`` smallest hashes of their doc_id.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, slices, table

SAMPLE = 1000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Text:
    """A text's measures, each computed once and when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # between ASCII white space

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_letter_words(self) -> int:
        return sum(map(bool, map(LETTER.search, self.words)))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:  # two windows of three words start at different places
            return 0
        number: dict[bytes, int] = {}
        w = np.fromiter((number.setdefault(x, len(number)) for x in self.words), np.int64, n)
        pairs, first = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)
        _, inverse, counts = np.unique(first[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        return int(cover.sum())


#: Rules of the contract: too short, or mostly repeated.
BASE: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}
#: True: the text is rejected. None is true of a text without words but few_words.
RULES = BASE | {
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "no_letters": lambda t: 10 * t.n_letter_words < 7 * t.n_words,
}


def costs(docs: DataFrame, sample: int = SAMPLE) -> list[dict]:
    """Each rule's seconds, rejections and texts on the sample."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = "rule string, seconds double, rejected long, texts long"

    def run(batches):
        spent, rejected, texts = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for b in batches:
            for text in b["text"].to_pylist():
                texts += 1
                for name, rule in RULES.items():
                    fresh = Text(text)  # a rule pays for all that it needs
                    began = time.perf_counter()
                    rejected[name] += rule(fresh)
                    spent[name] += time.perf_counter() - began
        yield record_batch({"rule": list(RULES), "seconds": list(spent.values()), "rejected": list(rejected.values()), "texts": [texts] * len(RULES)}, schema)

    each = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(run, schema)
    return [r.asDict() for r in each.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("seconds", "rejected", "texts"))).collect()]


def order(measured: list[dict]) -> list[str]:
    """Rules by rejections per second, most first; rules without a figure as listed."""
    worth = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in measured}
    return sorted(RULES, key=lambda name: (-worth.get(name, 0.0), list(RULES).index(name)))


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)


def verdicts(docs: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(doc_id, kept, failed_rule): the cascade alone, which computes no more than it needs.

    Takes (doc_id long, text string); other columns are ignored. A row for each input row, each by
    itself, so repeated rows get equal results. A null text has no words and is rejected. Which rule
    a rejected text fails depends on the measured order. An empty table gives no rows.
    """
    rules = rules or order(costs(docs))
    schema = "doc_id long, kept boolean, failed_rule string"

    def run(batches):
        for b in slices(batches, 1000):
            texts = map(Text, b["text"].to_pylist())
            failed = [next((name for name in rules if RULES[name](t)), None) for t in texts]
            yield record_batch({"doc_id": b["doc_id"].cast(pa.int64()), "kept": [f is None for f in failed], "failed_rule": failed}, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def measures(docs: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """The cascade's verdict beside the contract's measures, which every text gets.

    Takes (doc_id long, text string); other columns are ignored, whatever their names. A row for each input row, each by itself, so repeated rows get
    equal results. A null or empty text has no words, measures of 0, and is rejected. Long texts are measured whole. An empty table gives no rows.
    """
    rules = rules or order(costs(docs))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in slices(batches, 1000):
            out: dict = {n: [] for n in [*names, "base_failed", "kept"]}
            for text in b["text"].to_pylist():
                t = Text(text)
                out["kept"].append(not any(RULES[name](t) for name in rules))
                out["base_failed"].append(any(rule(t) for rule in BASE.values()))
                for n in names:
                    out[n].append(getattr(t, n))
            yield record_batch(out | {"doc_id": b["doc_id"].cast(pa.int64())}, RESULT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS letters
  FROM d),
g AS (SELECT doc_id, s, w[s:s + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS p FROM r) GROUP BY 1),
x AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines, letters
  FROM m LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 2 * n_dup_lines > n_lines OR 10 * letters < 7 * n_words) AS kept
FROM x
"""
