"""Language identification by fusing Bayesian evidence.

    P(lang | all) ~ P(text | lang)^t  P(declared | lang)  P(suffix | lang)  P(lang | host)

Text likelihoods are a naive Bayes model of hashed byte trigrams, fitted on ``SAMPLE`` labelled documents, as many of each
language, those with the smallest hashes of their doc_id (of more languages than that, one document each); they are tempered to the weight of ``EVIDENCE``
trigrams at most, as neighbouring trigrams are not independent. Declared markup language (a page's lang
attribute, a document's lang column) and address suffix (top-level domain and a two-letter first
path segment) have smoothed likelihoods; the host's prior is smoothed towards its registered
domain's, and that towards the corpus's. All these are counted over all rows by grouped
aggregation of the languages that the texts alone speak for; a row's own count is left out of
its host's and domain's.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, bounded, hot_join, record_batch, slices, table

SAMPLE = 2000
BITS = 16
EVIDENCE = 100
#: Weight of the broader prior, in rows.
PRIOR_ROWS = 10.0
HIDDEN = re.compile(r"(?i)<(script|style)\b")
CLOSED = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style")}
ELEMENT, DECLARED = r"(?i)<html\b[^>]*", r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def bare(html: str) -> str:
    """A space in place of each comment, script, style and tag. What isn't closed is text; one look forward tells that for all that follows."""
    out, at, open_, missing = [], 0, html.find("<"), set()
    while open_ >= 0:
        end = -1
        if html.startswith("<!--", open_) and "-->" not in missing:
            end = html.find("-->", open_ + 4) + 3
            if end < 3:
                missing.add("-->")
                end = -1
        elif found := HIDDEN.match(html, open_):
            name = found[1].lower()
            if name not in missing:
                close = CLOSED[name].search(html, found.end())
                end = close.end() if close else -1
                if not close:
                    missing.add(name)
        if end < 0:
            end = html.find(">", open_ + 1) + 1
            if not end:
                break
        out.append(html[at:open_])
        at, open_ = end, html.find("<", end)
    return " ".join([*out, html[at:]])


def trigrams(text: str) -> np.ndarray:
    a = np.frombuffer(f" {text} ".encode(), np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.int64)
    h = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


class Model(NamedTuple):
    """Log-likelihoods of hashed trigrams: ``unseen`` of each language, and what the cells that a language has been seen with add to it."""

    unseen: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    more: np.ndarray

    @classmethod
    def fit(cls, n_langs: int, lang: np.ndarray, cell: np.ndarray, n: np.ndarray) -> Model:
        order = np.lexsort((lang, cell))
        lang, cell, n = lang[order], cell[order], n[order]
        total = np.bincount(lang, n, n_langs) + 0.5 * (1 << BITS)
        return cls(np.log(0.5 / total), np.searchsorted(cell, np.arange((1 << BITS) + 1)), lang, np.log((n + 0.5) / 0.5))

    def loglik(self, cells: np.ndarray) -> np.ndarray:
        which, times = np.unique(cells, return_counts=True)
        first, n = self.starts[which], self.starts[which + 1] - self.starts[which]
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return len(cells) * self.unseen + np.bincount(self.langs[at], self.more[at] * np.repeat(times, n), len(self.unseen))


def fit_text(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], Model]:
    """Languages, by name, and their model.

    The tasks count trigrams by language; the driver gets the counts of cells that occur, 2 ** BITS a language at most. Every language is learnt, a rare one from
    all its documents. Rows with a null doc_id or lang don't count, null texts have no trigrams; of rows that share a doc_id all count. Other
    columns are ignored. Without labelled rows there are no languages.
    """
    labelled = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("long"), "lang", "text")
    ids = labelled.select("lang", "doc_id").distinct().withColumn("h", F.xxhash64("doc_id"))
    rows_of = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    langs = sorted(rows_of)
    share = max(1, sample // max(1, len(langs)))
    # Of a common language only hashes low enough to be among the share's, with room to spare, are put in order.
    room = share + 10 * math.sqrt(share) + 20
    below = [(lang, int(min(1.0, room / n) * (1 << 64)) - (1 << 63) - 1) for lang, n in rows_of.items()]
    bounds = ids.sparkSession.createDataFrame(below, "lang string, below long")  # a row a language
    ids = ids.join(F.broadcast(bounds), "lang").where("h <= below")
    ids = ids.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("place") <= share).select("lang", "doc_id")
    texts = labelled.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi")
    schema = "lang string, cell int, n long"

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for b in slices(batches, 1000):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                cells, n = np.unique(trigrams(text or ""), return_counts=True)
                held = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                held[cells] += n
        for lang, n in counts.items():
            cell = np.flatnonzero(n)
            yield record_batch({"lang": [lang] * len(cell), "cell": cell, "n": n[cell]}, schema)

    rows = texts.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    number = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    return langs, Model.fit(len(langs), lang, rows["cell"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(float))


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))
    segment = F.regexp_extract("url", r"^[A-Za-z]+://[^/]*/([A-Za-z]{2})(?:[/?#-]|$)", 1)
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("html").alias("text"),
        F.lower(F.nullif(F.regexp_extract(F.regexp_extract("html", ELEMENT, 0), DECLARED, 1), F.lit(""))).alias("declared"),
        F.nullif(F.concat_ws("/", F.nullif(F.regexp_extract(host, r"([^.]*)$", 1), F.lit("")), F.nullif(F.lower(segment), F.lit(""))), F.lit("")).alias("suffix"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.lit(True).alias("markup"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    source = F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("page_id"),
        "text",
        F.lower("lang").alias("declared"),
        F.lit(None).cast("string").alias("suffix"),
        source.alias("host"),
        F.lit("source:").alias("domain"),
        F.lit(False).alias("markup"),
    )


ROW = "doc_id long, page_id long, declared string, suffix string, host string, domain string, loglik array<double>, own int"


def text_evidence(rows: DataFrame, langs: list[str], model: Model) -> DataFrame:
    """Tempered log-likelihoods and own, the language that the text alone speaks for (from 1; 0: no text)."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))  # of the sample's size, whatever the rows

    def run(batches):
        known = Model(*shared.value)
        for b in slices(batches, 1000):
            loglik, own = [], []
            for text, markup in zip(b["text"].to_pylist(), b["markup"].to_pylist()):
                g = trigrams(bare(text or "") if markup else text or "")
                total = known.loglik(g)
                loglik.append(total * (min(1.0, EVIDENCE / len(g)) if len(g) else 0.0))
                own.append(int(total.argmax()) + 1 if len(g) > 2 and len(langs) else 0)
            yield record_batch({n: b[n] for n in b.schema.names if n not in ("text", "markup")} | {"loglik": loglik, "own": own}, ROW)

    return rows.mapInArrow(run, ROW)


def _counts(rows: DataFrame, by: list[str], name: str, n: int) -> DataFrame:
    """For each key its rows, n__, and an array of those of each language."""
    own = rows.groupBy(*by, "own").agg(F.count("*").alias("c")).groupBy(*by)
    own = own.agg(F.map_from_entries(F.collect_list(F.struct("own", "c"))).alias("m"), F.sum("c").alias("n__"))  # an entry a language
    return own.select(*by, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("double")).alias(name), "n__")


def identify(rows: DataFrame, langs: list[str], model: Model) -> DataFrame:
    """(doc_id, page_id, lang, probability, text_lang) for rows of ``page_rows`` or ``document_rows``.

    A row for each input row; rows that repeat are counted and answered each. A missing declaration,
    suffix or text is no evidence; hosts that are missing are one host. lang is null where the model
    has no languages. Ties go to the first language by name. Long texts count whole. An empty table
    gives no rows. Columns are those of ``ROW`` with text and markup in place of loglik and own; others are an error. A key's rows (a host's, a
    declaration's) are never brought together: what they need goes to them by a broadcast, or by ``hot_join``.
    """
    n = len(langs)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"))
    space = Workspace(rows.sparkSession, "language")
    seen = space.save(text_evidence(rows, langs, model), "rows")
    of = {r["own"]: r["count"] for r in seen.groupBy("own").count().collect()}
    total = [float(of.get(k, 0)) for k in range(1, n + 1)]
    prior = [(c + 1) / (sum(total) + n) for c in total]

    def likelihood(by: str) -> DataFrame:
        """P(value | lang) for each value of a column, with one unseen value."""
        kept = _counts(seen.where(F.col(by).isNotNull()), [by], "c", n)
        return kept.select(by, "n__", F.zip_with("c", F.lit(total), lambda c, t: F.log((c + 0.5) / (t + 1.0))).alias(f"{by}_log"))

    hosts = _counts(seen, ["domain", "host"], "at_host", n)
    domains = _counts(seen, ["domain"], "at_domain", n).drop("n__")
    # The keys' tables are joined first, so rows meet each only once.
    both = hosts.join(domains, "domain").select("domain", "host", "n__", F.struct("at_host", "at_domain").alias("prior__"))
    tables = [(both, ["domain", "host"]), (likelihood("declared"), ["declared"]), (likelihood("suffix"), ["suffix"])]
    count, joined = seen.count(), seen
    for found, on in tables:
        small, is_small = bounded(found, F.lit(16 * n) + F.octet_length(F.concat_ws("", *on)))
        joined = joined.join(small.drop("n__"), on, "left") if is_small else hot_join(joined, found, on, "n__", count)
    joined = joined.select("*", "prior__.*")
    return joined.select("doc_id", "page_id", "own", "loglik", "declared_log", "suffix_log", "at_host", "at_domain").mapInArrow(_decided(langs, np.array(prior)), FOUND)


FOUND = "doc_id long, page_id long, lang string, probability double, text_lang string"


def _decided(langs: list[str], prior: np.ndarray):
    """The evidence of each row put together, its own count left out of its host's and domain's."""
    n = len(langs)

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), n))
        out[column.is_valid().to_numpy(zero_copy_only=False)] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        return out

    def run(batches):
        for b in slices(batches, 1000):
            loglik, declared, suffix, host, domain = (matrix(b[c]) for c in ("loglik", "declared_log", "suffix_log", "at_host", "at_domain"))
            own = b["own"].to_numpy()
            itself = own[:, None] == np.arange(1, n + 1)
            broader = prior
            for counts in (domain - itself, host - itself):
                broader = (counts + PRIOR_ROWS * broader) / (counts.sum(axis=1, keepdims=True) + PRIOR_ROWS)
            score = loglik + declared + suffix + np.log(broader)
            best = score.argmax(axis=1)
            share = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
            text_lang = [langs[k - 1] if k else None for k in own]
            yield record_batch({"doc_id": b["doc_id"], "page_id": b["page_id"], "lang": [langs[k] for k in best], "probability": share, "text_lang": text_lang}, FOUND)

    return run


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = fit_text(docs)
    rows = page_rows(table(spark, sf_dir, "pages")).unionByName(document_rows(docs))
    return identify(rows, langs, model)
