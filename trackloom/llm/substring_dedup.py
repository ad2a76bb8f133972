"""Substring dedup by level-wise doubling.

A window of ``window`` words can only repeat if its sub-windows do. The levels' lengths are
halves of the window's (5, 10, 20 for 20). At each level, a window that is still a candidate
is represented by one sub-window of the level's length: the one with the least hash. Equal
windows have equal representatives, so a window whose representative occurs once is alone
and leaves; only what repeats is extended to twice the length and asked about again, until
the full length is reached or no candidates survive. At the full length the owner of each
window names the first place that holds it.

Shuffled are the representatives (a ninth of all positions at the first level), then what
survives; the texts stay in the bucketed chunk table. Windows are compared by 64-bit hashes
built from hashes of their halves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .chunks import NULL_ID, QUESTION, bucket_of, chunk_table, n_buckets, per_bucket, per_chunk, questions
from .common import Workspace, pack, table

WINDOW = 20
FIRST = 5
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths of the levels, each at most twice the one before: 20 -> 5, 10, 20."""
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return a ^ (a >> np.uint64(33))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on, from hashes of the two halves.

    Positions less than ``length`` from the end get values that callers must not use.
    """
    if length == 1:
        return mix(words)
    half = -(-length // 2)
    h, at = window_hashes(words, half), length - half
    later = np.zeros_like(h)
    later[: max(0, len(h) - at)] = h[at:]
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + later + np.uint64(length))


def slide(a: np.ndarray, k: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of a[i : i + k], as far as there are values."""
    out, have = a.copy(), 1
    while have < k:
        step = min(have, k - have)
        if step < len(out):
            out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def _candidates(chunk, window: int) -> np.ndarray:
    """True at the positions where a whole window of one document starts."""
    ok = np.zeros(len(chunk.tokens) + 1, np.int64)
    full = chunk.lens >= window
    np.add.at(ok, chunk.starts[full], 1)
    np.add.at(ok, (chunk.starts + chunk.lens)[full] - window + 1, -1)
    return np.cumsum(ok)[:-1] > 0


class _Levels:
    """A chunk's state after the levels that have been answered."""

    def __init__(self, chunk, answers: list, window: int):
        self.chunk, self.window = chunk, window
        self.words = np.append(np.uint64(0), chunk.hashes)[chunk.tokens]
        self.alive = _candidates(chunk, window)
        for length, got in zip(levels(window)[:-1], answers):
            at, which, _, _ = self.ask(length)
            self.alive[at] = _bits(got)[which]

    def ask(self, length: int):
        """Positions of candidates, the number of each one's key, the sorted keys and their counts here."""
        spread = np.uint64(0xD6E8FEB86659FD93)  # the least hashes are small numbers; keys are uniform
        k = self.window - length + 1
        h = window_hashes(self.words, length)
        least = slide(h, k, np.minimum)
        # A sub-window represents some candidate if the largest of the minima that can be it, is it.
        held = np.where(self.alive, least, np.uint64(0))
        place = slide(held[::-1], k, np.maximum)[::-1] == h
        keys, counts = np.unique(h[place] * spread, return_counts=True)
        at = np.flatnonzero(self.alive)
        return at, np.searchsorted(keys, least[at] * spread), keys, counts


def _bits(got: list) -> np.ndarray:
    return np.concatenate([np.unpackbits(bits)[: n[0]] for bits, n in got] or [np.empty(0)]) > 0


def _ask_level(length: int, window: int, buckets: int):
    def ask(chunk, answers):
        _, _, keys, counts = _Levels(chunk, answers, window).ask(length)
        yield questions(chunk.id, bucket_of(keys, buckets).astype(np.int64), keys, counts > 1)

    return ask


def _repeated(bucket: int, chunks: list[int], got: list) -> pd.DataFrame:
    _, inverse, counts = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True, return_counts=True)
    again = (counts > 1) | (np.bincount(inverse, np.concatenate([g[1] for g in got])) > 0)
    return _answers(bucket, chunks, got, again[inverse])


def _answers(bucket: int, chunks: list[int], got: list, yes: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum([len(g[0]) for g in got])
    payloads = [pack(np.packbits(yes[e - len(g[0]) : e]), np.array([len(g[0])])) for g, e in zip(got, ends)]
    return pd.DataFrame({"chunk": chunks, "bucket": bucket, "payload": payloads})


def _ask_first(window: int, buckets: int):
    """The chunk's first (doc_id, start) of every window that is still a candidate."""

    def ask(chunk, answers):
        keys, doc, start = _first_places(chunk, answers, window)[1:]
        yield questions(chunk.id, bucket_of(keys, buckets).astype(np.int64), keys, doc, start)

    return ask


def _first_places(chunk, answers, window: int):
    state = _Levels(chunk, answers, window)
    at = np.flatnonzero(state.alive)
    h = window_hashes(state.words, window)[at]
    which = np.searchsorted(chunk.starts, at, side="right") - 1
    doc, start = chunk.doc_ids[which], (at - chunk.starts[which]).astype(np.int32)
    order = np.lexsort((start, doc, h))
    first = np.flatnonzero(np.diff(h[order], prepend=h[order[:1]] ^ np.uint64(1))) if len(at) else order
    keys = order[first]
    return (at, h, doc, start), h[keys], doc[keys], start[keys]


def _is_first(bucket: int, chunks: list[int], got: list) -> pd.DataFrame:
    keys, doc, start = (np.concatenate([g[k] for g in got]) for k in range(3))
    order = np.lexsort((start, doc, keys))
    group = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) != 0)
    best = order[np.flatnonzero(np.diff(group, prepend=-1))][group]  # of each sorted entry's window
    first = np.empty(len(keys), bool)
    first[order] = (doc[best] == doc[order]) & (start[best] == start[order])
    return _answers(bucket, chunks, got, first)


def _result(window: int):
    def result(chunk, answers):
        (at, h, doc, start), keys, first_doc, first_start = _first_places(chunk, answers[:-1], window)
        cover = np.zeros(len(chunk.tokens) + 1, np.int64)
        if len(at):
            is_first = _bits(answers[-1])
            k = np.searchsorted(keys, h)
            gone = at[~(is_first[k] & (first_doc[k] == doc) & (first_start[k] == start))]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + window, -1)
        kept = np.cumsum(cover)[:-1] == 0
        words = np.array(chunk.words(), dtype=object)
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for doc_id, s, n in zip(chunk.doc_ids.tolist(), chunk.starts.tolist(), chunk.lens.tolist()):
            numbers = chunk.tokens[s : s + n][kept[s : s + n]]
            left = b" ".join(words[numbers])
            out["doc_id"].append(None if doc_id == NULL_ID else doc_id)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(numbers))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["kept"].append(left.decode())
        yield out

    return result


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove each word that a repeated window covers, but for the window's first place.

    Takes (doc_id long, text string); other columns are ignored. Returns doc_id, n_words,
    n_removed, kept_sha256 and kept (the text that is left, words joined by one space), a row
    for each input row. First means the smaller doc_id, then the earlier start; a null doc_id
    sorts first, a null text has no words. Rows that share a doc_id are documents of their own;
    windows at the same start of two such rows are ties, and neither is earlier. An empty table
    gives no rows. Texts of any length are processed whole.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "substrings")
    chunks = chunk_table(docs, space, lower=False, end=False, words=True)
    buckets, answers = n_buckets(chunks), []
    for length in levels(window)[:-1]:
        asked = per_chunk(chunks, answers, _ask_level(length, window, buckets), QUESTION)
        answers.append(space.save(per_bucket(asked, _repeated, QUESTION), f"level{length}"))
    asked = per_chunk(chunks, answers, _ask_first(window, buckets), QUESTION)
    answers.append(space.save(per_bucket(asked, _is_first, QUESTION), f"level{window}"))
    return per_chunk(chunks, answers, _result(window), RESULT + ", kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


#: Every 20-word window by its words; a place is covered if a window that also starts earlier holds it.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
dup AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
hit AS (SELECT DISTINCT doc_id, s + o AS p FROM dup, range(0, 20) AS r(o)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (
  SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
