"""Katz backoff language model of any order, trained on and applied to a whole corpus.

Simple Good-Turing discounts take mass from n-grams seen up to five times; a context gives that mass
to the words it was not seen with, in proportion to their probability one order lower; the lowest is
discounted in the same way in favour of one unknown word:

    p(w)     = d(c) c / N                      p(unknown) = 1 - sum of these
    p(w|u v) = d(c(u v w)) c(u v w) / c(u v)   if the n-gram was seen
             = a(u v) p(w|v)                   else; a(u v) makes the sum over all w exactly 1

A context whose n-grams are all seen more than five times has nothing discounted; there, counts
are divided by c + 1. A context that training lacks has a = 1. Each document is scored by
the recursion for each of its tokens; the first is in the context of the document's start, the second has a word less than a
trigram's context, and so on.

Counts live in written tables, one for each order, by buckets of words and of contexts. Chunks of documents ask
the buckets for the counts of their distinct words, then of their distinct bigrams, and so on up (see
``chunks``). A bucket owns whole contexts, so it can add up what normalising needs; contexts with
more than a 1024th of all tokens (1024 of them at most in an order) are spread over buckets by their last
word, and their sums, a row each, are added by Spark and sent to all tasks. From the trigrams on a context goes by a 64-bit hash, and
probabilities of the order below by 32-bit floats, on both sides alike, so that sums are still exactly 1.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import NULL_ID, QUESTION, Chunk, bucket_of, chunk_table, n_buckets, per_bucket, per_chunk
from .common import Workspace, pack, record_batch, table, unpack
from .substring_dedup import mix

#: Words of the longest n-grams, unless another order is asked for. Trigrams take about twice the time, memory and disk (see the README).
ORDER = 2
#: Counts up to this are discounted.
K = 5
#: Contexts with more than this share of the training tokens are spread over buckets.
HOT_SHARE = 1 / 1024
#: A chunk here holds its bigrams several times over in numpy arrays.
CHUNK_TOKENS = 500_000
#: Tokens to a bucket, whose entries a task holds several times over.
BUCKET_TOKENS = 200_000
HELD_OUT = 10
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
END = np.uint64(xxhash.xxh64_intdigest(b" end"))  # no word has a space

COUNTS = [f"n{r}" for r in range(1, K + 2)]
#: kind answer: for a chunk; table: counts of a bucket's keys, with counts of counts; hot: sums of a hot context.
ANSWER = (
    "kind string, chunk long, bucket int, payload binary, context long, p_seen double, types long, tokens long, last long, "
    + ", ".join(f"{c} long" for c in COUNTS)
)


def held_out(doc_id: int) -> bool:
    """True for a tenth of the documents; a null doc_id reads as an empty text and is held out."""
    text = "" if doc_id == NULL_ID else str(doc_id)
    return zlib.crc32(text.encode()) % HELD_OUT == 0


def good_turing(n: list[int]) -> tuple[np.ndarray, str]:
    """Discounts d[0..K] for counts from n[r - 1] keys seen r times, r to K + 1, and the method: "good-turing" or, rarely, "absolute".

    Simple Good-Turing: counts of counts, averaged over the gaps between those that occur, lie about a line of logarithms. Raw estimates of a true
    count, (r + 1) n(r + 1) / n(r), hold up to the first r where they and the line's don't differ by more than chance, the line's from there on, and
    where a raw one would leave no discount between 0 and 1. The line gives such discounts whenever it falls faster than 1 / r; only where it doesn't,
    or has fewer than two points, absolute discounting takes its place.
    """
    r, counts = np.arange(1, K + 2), np.array(n, float)
    seen = np.flatnonzero(counts > 0)
    d = np.ones(K + 1)
    if len(seen) >= 2:
        before = np.append(0, r[seen][:-1])
        after = np.append(r[seen][1:], 2 * r[seen][-1] - before[-1])
        slope = np.polyfit(np.log(r[seen]), np.log(2 * counts[seen] / (after - before)), 1)[0]
        if slope < -1:
            share = (1 + 1 / r[:K]) ** (slope + 1)  # of a count that is kept, by the line
            common = (K + 1.0) ** (slope + 1)
            for i in range(K):
                if not (counts[i] and counts[i + 1]):
                    break
                raw = (i + 2) * counts[i + 1] / counts[i] / (i + 1)
                spread = (i + 2) / (i + 1) * counts[i + 1] / counts[i] * np.sqrt(1 / counts[i + 1] + 1 / counts[i])
                if abs(raw - share[i]) <= 1.96 * spread:
                    break
                if common < raw < 1:
                    share[i] = raw
            d[1:] = (share - common) / (1 - common)
            return d, "good-turing"
    less = counts[0] / (counts[0] + 2 * counts[1]) if counts[0] and counts[1] else 0.5
    d[1:] = (r[:K] - less) / r[:K]
    return d, "absolute"


class Unigrams(NamedTuple):
    """The few numbers that turn a word's count into its probability."""

    tokens: int
    types: int
    d: np.ndarray
    unknown: float

    @classmethod
    def fit(cls, tokens: int, types: int, n: list[int]) -> Unigrams:
        d = np.append(good_turing(n)[0], 1.0)
        r = np.arange(1, K + 1)
        kept = tokens - float(((1 - d[1 : K + 1]) * r * np.array(n[:K])).sum())
        if kept >= tokens:  # nothing is discounted: the unknown word counts as one more token
            return cls(tokens, types, d, 1 / (tokens + 1))
        return cls(tokens, types, d, 1 - kept / tokens)

    def p(self, counts: np.ndarray) -> np.ndarray:
        scale = 1 / (self.tokens + 1) if self.unknown == 1 / (self.tokens + 1) else 1 / max(1, self.tokens)
        seen = counts * self.d[np.minimum(counts, K + 1)] * scale
        return np.where(counts > 0, seen, self.unknown)


class Layout(NamedTuple):
    """How words and contexts are numbered and dealt to buckets."""

    buckets: int
    shift: int
    hot: float

    @property
    def start(self) -> np.uint64:
        return np.uint64((self.buckets << self.shift) + 1)

    @property
    def wide(self) -> bool:
        return int(self.start).bit_length() > 32

    def bucket(self, context, word, hot):
        return bucket_of(mix(np.where(hot, mix(context) + word, context)), self.buckets).astype(np.int64)


# --- words


def _vocabulary(chunk: Chunk):
    hashes = np.append(END, chunk.hashes)
    return hashes, np.argsort(hashes)


def _train(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    held = np.array([held_out(i) for i in chunk.doc_ids.tolist()], bool)
    return held, np.repeat(~held, chunk.lens)


def _ask_words(buckets: int):
    def ask(chunk, answers):
        hashes, order = _vocabulary(chunk)
        counts = np.bincount(chunk.tokens[_train(chunk)[1]], minlength=len(hashes))
        keys = hashes[order]
        yield _questions(chunk.id, bucket_of(keys, buckets).astype(np.int64), lambda i, j: (keys[i:j], counts[order[i:j]]))

    return ask


def _questions(chunk: int, bucket: np.ndarray, columns) -> dict:
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at[1:], len(bucket))
    return {
        "chunk": [chunk] * len(at),
        "bucket": bucket[at].tolist(),
        "payload": [pack(*columns(i, j)) for i, j in zip(at, ends)],
    }


def _answer_words(bucket: int, chunks: list[int], got: list) -> pd.DataFrame:
    keys, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate([g[1] for g in got])).astype(np.int64)
    ends = np.cumsum([len(g[0]) for g in got])
    parts = [inverse[e - len(g[0]) : e] for g, e in zip(got, ends)]
    return _rows(bucket, chunks, [pack(totals[p], p) for p in parts], pack(keys, totals), totals, len(keys))


def _rows(bucket, chunks, answers, counted, totals, last, hot=()) -> pd.DataFrame:
    few = np.bincount(np.minimum(totals, K + 2), minlength=K + 3)
    rows = [{"kind": "answer", "chunk": c, "bucket": bucket, "payload": a} for c, a in zip(chunks, answers)]
    of_all = {"types": int((totals > 0).sum()), "tokens": int(totals.sum()), "last": last}
    of_all |= {c: int(few[r]) for r, c in enumerate(COUNTS, 1)}
    rows.append({"kind": "table", "bucket": bucket, "payload": counted} | of_all)
    names = [x.strip().rsplit(" ", 1)[0] for x in ANSWER.split(",")]
    frame = pd.DataFrame([*rows, *hot], columns=names, dtype=object)  # contexts are 64-bit numbers, which floats can't hold
    return frame.astype({n: "Int64" for n in ["chunk", "context", "types", "tokens", "last", *COUNTS]} | {"p_seen": "Float64"})


# --- n-grams


class Level(NamedTuple):
    """What scoring an order needs beside the answers: discounts, and the sums of the hot contexts."""

    d: np.ndarray
    hot: dict  # context -> (n1 .. nK, tokens seen more often, p_seen)


class Words:
    """A chunk's words with their numbers and training counts."""

    def __init__(self, chunk: Chunk, answer: list, layout: Layout):
        hashes, order = _vocabulary(chunk)
        n = len(hashes)
        self.count, self.number = np.zeros(n + 1, np.int64), np.full(n + 1, layout.start, np.uint64)
        self.count[order] = np.concatenate([a[0] for a in answer])
        bucket = bucket_of(hashes[order], layout.buckets)
        self.number[order] = (bucket << np.uint64(layout.shift)) | np.concatenate([a[1] for a in answer]).astype(np.uint64)
        self.count[n] = self.count[0]  # a document starts as often as one ends
        self.hot = self.count > layout.hot
        self.hot[n] = True


class Grams:
    """A chunk's distinct n-grams, in the order of their buckets, contexts and words; from bigrams up, each order on the one below."""

    def __init__(self, chunk: Chunk, words: Words, layout: Layout, unigrams: Unigrams, lower: Grams | None = None):
        tokens, size = chunk.tokens.astype(np.int64), len(words.number)
        self.words, self.unigrams, self.n = words, unigrams, lower.n + 1 if lower else 2
        if lower is None:
            at, before = np.arange(len(tokens)), np.empty_like(tokens)
            before[1:] = tokens[:-1]
            before[chunk.starts] = size - 1
            key, self.count, self.hot = words.number, words.count, words.hot
        else:
            place = np.arange(len(tokens)) - np.repeat(chunk.starts, chunk.lens)
            at = np.flatnonzero(place >= self.n - 2)
            before = lower.of_token[at - 1]
            key, self.count = mix(mix(lower.context) + lower.word), lower.seen
            self.hot = self.count > layout.hot
        pairs, inverse = np.unique(before * size + tokens[at], return_inverse=True)
        first, second = pairs // size, pairs % size
        context, word = key[first], words.number[second]
        bucket = layout.bucket(context, word, self.hot[first])
        order = np.lexsort((word, context, bucket))
        of = np.empty_like(order)
        of[order] = np.arange(len(order))
        self.of_token = np.full(len(tokens), -1)
        self.of_token[at] = of[inverse]
        self.first, self.second, self.bucket = first[order], second[order], bucket[order]
        self.context, self.word = context[order], word[order]
        if lower is None:
            self.below = unigrams.p(words.count[self.second])
        else:
            suffix = np.empty(len(order), np.int64)
            suffix[self.of_token[at]] = lower.of_token[at]
            self.below = lower.p[suffix].astype(np.float32).astype(np.float64)

    def runs(self, i: int, j: int) -> np.ndarray:
        """Where contexts begin among the n-grams i to j."""
        return np.flatnonzero(np.diff(self.context[i:j], prepend=self.context[i] ^ np.uint64(1)))

    def solve(self, answer: list, level: Level) -> None:
        """The training counts ``seen``, and the probabilities ``p`` of the words in their contexts."""
        self.seen = np.concatenate([a[0] for a in answer] or [np.empty(0, np.int64)])
        size = len(self.count)
        full, sums, known = np.zeros(size, bool), np.zeros((size, K + 2)), np.zeros(size, bool)
        ends = np.cumsum([len(a[0]) for a in answer])
        for a, e in zip(answer, ends):
            i, j = e - len(a[0]), e
            at = self.runs(i, j)
            first = self.first[i:j][at]
            full[first] = a[1]
            lacking = first[np.minimum.reduceat(a[0], at) == 0]
            sums[lacking] = np.stack(a[2:], axis=1)
            known[lacking] = True
        hot = self.hot[self.first]
        for local, context in dict(zip(self.first[hot].tolist(), self.context[hot].view(np.int64).tolist())).items():
            s = level.hot.get(context)
            if s is not None:
                sums[local], known[local], full[local] = s, True, sum(s[:K]) == 0 and s[K] > 0
        total = self.count + full  # of a context
        with np.errstate(divide="ignore", invalid="ignore"):
            mass = (sums[:, :K] * (level.d[1:] * np.arange(1, K + 1))).sum(axis=1) + sums[:, K]
            alpha = (1 - mass / total) / (1 - sums[:, K + 1])
            alpha = np.where(known & (self.count > 0), alpha, 1.0)
            found = self.seen * level.d[np.where(self.seen > K, 0, self.seen)] / total[self.first]
            self.p = np.where(self.seen > 0, found, alpha[self.first] * self.below)


def _grams(chunk, answers, layout: Layout, unigrams: Unigrams, levels: list[Level]) -> tuple[Words, Grams | None]:
    """The highest order whose answers are there, solved from the bigrams up."""
    words, grams = Words(chunk, answers[0], layout), None
    for answer, level in zip(answers[1:], levels):
        lower, grams = grams, Grams(chunk, words, layout, unigrams, grams)
        grams.solve(answer, level)
        if lower is not None:  # a token too near to the start for this order keeps the lower one's probability
            grams.token_p = np.where(grams.of_token >= 0, grams.p[grams.of_token], lower.token_p)
        else:
            grams.token_p = grams.p[grams.of_token]
    return words, grams


def _ask_grams(layout: Layout, unigrams: Unigrams, levels: list[Level]):
    def ask(chunk, answers):
        words, lower = _grams(chunk, answers, layout, unigrams, levels)
        grams = Grams(chunk, words, layout, unigrams, lower)
        if not len(grams.bucket):
            return
        wide = np.uint64 if layout.wide else np.uint32
        kind = wide if grams.n == 2 else np.uint64
        held = _train(chunk)[1] & (grams.of_token >= 0)
        seen = np.bincount(grams.of_token[held], minlength=len(grams.first)).astype(np.int64)
        below = words.count[grams.second] if grams.n == 2 else grams.below.astype(np.float32)

        def columns(i, j):
            at = grams.runs(i, j)
            lens = np.diff(np.append(at, j - i))
            return grams.context[i:j][at].astype(kind), grams.hot[grams.first[i:j][at]], lens, grams.word[i:j].astype(wide), below[i:j], seen[i:j]

        yield _questions(chunk.id, grams.bucket, columns)

    return ask


def _answer_grams(unigrams: Unigrams, n: int):
    def answer(bucket: int, chunks: list[int], got: list) -> pd.DataFrame:
        context = np.concatenate([np.repeat(g[0].astype(np.uint64), g[2]) for g in got])
        hot = np.concatenate([np.repeat(g[1], g[2]) for g in got])
        word, below, seen = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
        order = np.lexsort((word, context))
        c, w = context[order], word[order]
        new = np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]
        del c, w
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        one = order[new]  # an entry of each distinct n-gram
        totals = np.bincount(inverse, seen, minlength=len(one)).astype(np.int64)
        p_below = unigrams.p(below[one]) if n == 2 else below[one].astype(np.float64)

        contexts, of = np.unique(context[one], return_inverse=True)
        few = [np.bincount(of, totals == r, minlength=len(contexts)) for r in range(1, K + 1)]
        many = np.bincount(of, np.where(totals > K, totals, 0), minlength=len(contexts))
        p_seen = np.bincount(of, np.where(totals > 0, p_below, 0), minlength=len(contexts))
        full = (sum(few) == 0) & (many > 0)

        answers, at = [], 0
        for g in got:
            size = len(g[3])
            mine = totals[inverse[at : at + size]]
            at += size
            which = np.searchsorted(contexts, g[0].astype(np.uint64))
            lacks = np.minimum.reduceat(mine, np.cumsum(g[2]) - g[2]) == 0
            i = which[lacks]
            answers.append(pack(mine, full[which], *(f[i].astype(np.int64) for f in few), many[i].astype(np.int64), p_seen[i]))

        is_hot = np.bincount(of, hot[one], minlength=len(contexts)) > 0
        signed = contexts.view(np.int64)
        rows = [
            {"kind": "hot", "bucket": bucket, "context": int(signed[i]), "p_seen": p_seen[i], "tokens": int(many[i])}
            | {f"n{r}": int(few[r - 1][i]) for r in range(1, K + 1)}
            for i in np.flatnonzero(is_hot)
        ]
        kept = totals > 0
        counted = pack(context[one][kept], word[one][kept], totals[kept])
        return _rows(bucket, chunks, answers, counted, totals, len(one), rows)

    return answer


def _scores(layout: Layout, unigrams: Unigrams, levels: list[Level]):
    def scores(chunk, answers):
        words, grams = _grams(chunk, answers, layout, unigrams, levels)
        n, v = unigrams.tokens, unigrams.types
        base = np.log10((words.count + 0.1) / (n + 0.1 * (v + 1)))[chunk.tokens]
        p = grams.token_p if grams is not None else unigrams.p(words.count)[chunk.tokens]
        yield {
            "doc_id": [None if i == NULL_ID else i for i in chunk.doc_ids.tolist()],
            "held_out": _train(chunk)[0],
            "n_tokens": chunk.lens,
            "n_known": np.add.reduceat((words.count > 0)[chunk.tokens].astype(np.int64), chunk.starts),
            "train_tokens": np.full(len(chunk.lens), n),
            "base_score": np.add.reduceat(base, chunk.starts),
            "score": np.add.reduceat(np.log10(p), chunk.starts),
        }

    return scores


COUNTED = "n int, bucket int, context long, word long, count long"


def readable(table: DataFrame, n: int) -> DataFrame:
    """(n, bucket, context, word, count): a row for each n-gram of a stored table of ``Katz``, to be read, joined or written by order and bucket.

    A word has the number bucket << shift | place of the words' table, where context is null; a bigram's context is a word's number, a longer one's a hash.
    """

    def run(batches):
        for b in batches:
            for bucket, payload in zip(b["bucket"].to_pylist(), b["payload"].to_pylist()):
                *context, word, count = unpack(payload)
                rows = {"n": np.full(len(word), n), "bucket": np.full(len(word), bucket), "word": word.astype(np.uint64).view(np.int64), "count": count}
                yield record_batch(rows | {"context": context[0].view(np.int64) if context else [None] * len(word)}, COUNTED)

    return table.select("bucket", "payload").mapInArrow(run, COUNTED)


class Katz(NamedTuple):
    """scores: a row for each document; tables: the model's counts by bucket (packed, see ``readable``), one table for each order."""

    scores: DataFrame
    tables: list[DataFrame]


def _add(df: DataFrame):
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", *COUNTS)]
    return df.where("kind = 'table'").agg(*sums, F.coalesce(F.max("last"), F.lit(0)).alias("last")).first()


def katz(docs: DataFrame, order: int = ORDER) -> Katz:
    """Fit on the training documents of ``docs`` (doc_id long, text string) and score all of them by n-grams of up to ``order`` words.

    Other columns are ignored. Gives a row for each input row, also where doc_ids repeat: rows that
    share a doc_id are documents of their own. A null text is empty and consists of the end token.
    A null doc_id is held out. Without training documents all words are the unknown word, with
    probability 1. Long texts are scored whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "katz")
    chunks = chunk_table(docs, space, lower=True, end=True, words=False, tokens=CHUNK_TOKENS)
    buckets = n_buckets(chunks, BUCKET_TOKENS)
    words = space.save(per_bucket(per_chunk(chunks, [], _ask_words(buckets), QUESTION), _answer_words, ANSWER), "grams1")
    got = _add(words)
    unigrams = Unigrams.fit(got["tokens"], got["types"], [got[c] for c in COUNTS])
    layout = Layout(buckets, max(1, int(got["last"]).bit_length()), got["tokens"] * HOT_SHARE)
    tables, levels = [words], []
    answer = lambda t: t.where("kind = 'answer'").select("chunk", "bucket", "payload")
    sums = [*COUNTS[:K], "tokens", "p_seen"]
    for n in range(2, order + 1):
        asked = per_chunk(chunks, list(map(answer, tables)), _ask_grams(layout, unigrams, list(levels)), QUESTION)
        grams = space.save(per_bucket(asked, _answer_grams(unigrams, n), ANSWER), f"grams{n}")
        of = _add(grams)
        hot = grams.where("kind = 'hot'").groupBy("context").agg(*(F.sum(c).alias(c) for c in sums)).collect()
        d = good_turing([of[c] for c in COUNTS])[0]
        d[0] = 1.0
        levels.append(Level(d, {r["context"]: [r[c] for c in sums] for r in hot}))
        tables.append(grams)
    kept = [t.where("kind = 'table'").select("bucket", "payload", "types", "tokens") for t in tables]
    return Katz(per_chunk(chunks, list(map(answer, tables)), _scores(layout, unigrams, levels), RESULT), kept)


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz(table(spark, sf_dir, "documents")).scores
