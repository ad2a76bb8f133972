"""SentencePiece encoding with seeded merge-dropout, and decoding.

The agenda holds every pair of neighbouring pieces whose join is a piece; the best score, then the
leftmost, comes off first and is merged. With dropout, a keyed hash of (seed, doc_id, place of the word in the
text, number of the candidate in its agenda) decides whether a candidate is skipped for good instead, so each occurrence
of a word is segmented by itself, and the same way on any executor. Without dropout the
pieces are SentencePiece's own. Every segmentation decodes to the text: characters that the
vocabulary lacks, and the space marker itself, become byte pieces.

No piece has the space marker after another character, so words are encoded one by one. What becomes of
a word depends on nothing but the numbers of its skipped candidates. A task therefore keeps the outcomes
that it has met as a tree: a node is a word and the candidates skipped so far, with the number of candidates that its agenda
gives; its child by k skips the candidate k as well. All words of a batch go down the tree together, candidate by
candidate; only an outcome that is new runs an agenda.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
#: Outcomes kept by a task, and texts looked at together.
KEPT = 250_000
BATCH = 500
#: Words of up to this many characters have fewer than 64 candidates: one for each pair, and two more for each merge. Longer ones are not kept.
SHORT = 21

SPACE = "▁"
#: Stands for the space marker as a character of the text; no valid text holds a lone surrogate.
ESCAPED = "\udc00"
#: More than any rank; less than any piece, and than the -1 of a character that is none.
NEVER = 1 << 30
DEAD = -2
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """A model's pieces, and the pairs of pieces that may merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(texts) if sp.is_byte(i)}
        self.id = {t: i for i, t in enumerate(texts) if not special[i] and not sp.is_byte(i)}
        if len(self.byte) < 256 or any(SPACE in t.lstrip(SPACE) for t in self.id):
            raise ValueError("the model needs byte pieces, and words that start with the space marker")
        self.bytes = [b""] * n
        for t, i in self.id.items():
            self.bytes[i] = t.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        # The rank of a piece is the place of its score; runs of spaces share one.
        places = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in range(n)}, reverse=True))}
        self.length = [0] * n
        for t, i in self.id.items():
            self.length[i] = len(t)
        #: The join of two neighbours, and its rank, by first << bits | second. A character that is no piece has the number -1, and no joins.
        self.bits = n.bit_length()
        self.join = {
            self.id[t[:k]] << self.bits | self.id[t[k:]]: i for t, i in self.id.items() for k in range(1, len(t)) if t[:k] in self.id and t[k:] in self.id
        }
        self.rank = {pair: places[sp.get_score(i)] for pair, i in self.join.items()}
        self.codes = np.array(sorted(self.join), np.int64)
        self.code_joins = np.array([self.join[c] for c in self.codes.tolist()], np.int32)
        self.code_ranks = np.array([self.rank[c] for c in self.codes.tolist()], np.int64)
        #: The piece of each rank, -1 where several share it.
        self.of_rank = np.full(len(places), -2, np.int32)
        for i in self.id.values():
            k = places[sp.get_score(i)]
            self.of_rank[k] = i if self.of_rank[k] == -2 else -1
        self.of_char = np.full(0x110000, -1, np.int32)
        for t, i in self.id.items():
            if len(t) == 1:
                self.of_char[ord(t)] = i

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the join of each two neighbours, or NEVER."""
        code = a.astype(np.int64) << self.bits | b
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[k] == code, self.code_ranks[k], NEVER)

    def merge(self, words: list[str], skipped: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Short words' pieces, as 32-bit integers, and how many candidates each one's agenda gave; bit k of its ``skipped`` skips candidate k.

        Words of one length are merged together, one candidate of each at a time. Their symbols are the rows of arrays, the words the columns.
        """
        out: list[bytes] = [b""] * len(words)
        given = np.zeros(len(words), np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lens[lens > 0]).tolist():
            which = np.flatnonzero(lens == n)
            text = "".join(words[i] for i in which.tolist())
            piece = np.ascontiguousarray(self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(-1, n).T)
            self._agenda(piece, skipped[which], given, which)
            found, kept = piece.T, piece.T > DEAD
            data, ends = found[kept].tobytes(), 4 * np.cumsum(kept.sum(axis=1))
            strange, at = (piece == -1).any(axis=0).tolist(), 0
            for i, end, odd in zip(which.tolist(), ends.tolist(), strange):
                out[i] = self.with_bytes(words[i], memoryview(data[at:end]).cast("i")) if odd else data[at:end]
                at = end
        return out, given

    def _agenda(self, piece: np.ndarray, skipped: np.ndarray, given: np.ndarray, which: np.ndarray) -> None:
        """Merges the symbols ``piece`` in place; a symbol that another has taken in is DEAD."""
        n, width = piece.shape
        # A symbol's candidate is the one with its right neighbour: its rank, then its row, so that the least is the leftmost.
        rows = np.arange(n, dtype=np.int64)[:, None]
        agenda = np.full((n, width), NEVER << 5, np.int64)
        agenda[:-1] = self.ranks(piece[:-1], piece[1:]) << 5 | rows[:-1]
        before, after = np.repeat(rows - 1, width, axis=1), np.repeat(rows + 1, width, axis=1)
        flat, cand, prev, next_ = piece.reshape(-1), agenda.reshape(-1), before.reshape(-1), after.reshape(-1)
        live = np.arange(width)
        while len(live):
            best = (agenda if len(live) == width else agenda[:, live]).min(axis=0)
            more = best < NEVER << 5
            live, best = live[more], best[more]
            row = best & 31
            at = row * width + live
            skip = (skipped[live] >> given[which[live]].astype(np.uint64) & np.uint64(1)).astype(bool)
            given[which[live]] += 1
            cand[at[skip]] = NEVER << 5
            merged = ~skip
            column, row, at, rank = live[merged], row[merged], at[merged], best[merged] >> 5
            gone = next_[at] * width + column
            new = self.of_rank[rank]
            shared = np.flatnonzero(new < 0)
            if len(shared):
                code = flat[at[shared]].astype(np.int64) << self.bits | flat[gone[shared]]
                new[shared] = self.code_joins[np.searchsorted(self.codes, code)]
            flat[at], flat[gone], cand[gone] = new, DEAD, NEVER << 5
            right, left = next_[gone], prev[at]
            next_[at] = right
            has = right < n
            to = right[has] * width + column[has]
            prev[to] = row[has]
            cand[at] = NEVER << 5
            cand[at[has]] = self.ranks(new[has], flat[to]) << 5 | row[has]
            has = left >= 0
            to = left[has] * width + column[has]
            cand[to] = self.ranks(flat[to], new[has]) << 5 | left[has]

    def merge_long(self, word: str, skipped: np.ndarray) -> bytes:
        """As ``merge``, by a heap, so in time n log n; ``skipped`` has True for the candidates to skip."""
        rank, bits, n = self.rank, self.bits, len(word)
        piece = [self.id.get(c, -1) for c in word]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        # A symbol has one candidate, with its right neighbour; the rank tells whether an entry still holds, or is as good as the one that does.
        now = [rank.get(a << bits | b, NEVER) for a, b in zip(piece, piece[1:])] + [NEVER]
        agenda = [r << 32 | i for i, r in enumerate(now) if r < NEVER]
        heapify(agenda)
        given = 0
        while agenda:
            best = heappop(agenda)
            i = best & 0xFFFFFFFF
            if now[i] != best >> 32:
                continue
            given += 1
            if skipped[given - 1]:
                now[i] = NEVER
                continue
            j = right[i]
            piece[i] = self.join[piece[i] << bits | piece[j]]
            now[j], piece[j], right[i] = NEVER, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (i, left[i]):
                if a >= 0:
                    b = right[a]
                    now[a] = rank.get(piece[a] << bits | piece[b], NEVER) if b >= 0 else NEVER
                    if now[a] < NEVER:
                        heappush(agenda, now[a] << 32 | a)
        return self.with_bytes(word, [p for p in piece if p is not None])

    def with_bytes(self, word: str, piece: list[int]) -> bytes:
        """The pieces with the bytes of each character that is none."""
        out, at = array("i"), 0
        for p in piece:
            out.extend([p] if p >= 0 else [self.byte[b] for b in (SPACE if word[at] == ESCAPED else word[at]).encode()])
            at += self.length[p] if p >= 0 else 1
        return out.tobytes()

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids))
        return data[1:].decode()


@cache
def model(path: str) -> Pieces:
    return Pieces(path)


def skips(key: np.ndarray | np.uint64, number: np.ndarray | int, dropout: float) -> np.ndarray:
    """Whether the candidate ``number`` of the word with this 64-bit ``key`` is skipped: so for a share ``dropout`` of all."""
    h = np.atleast_1d(key) + np.atleast_1d(np.asarray(number).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < dropout * (1 << 53)


class Outcomes:
    """The tree of the outcomes of short words. ``roots`` has the node of each word without a skip."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.roots: dict[str, int] = {}
        self.children: dict[int, int] = {}
        self.word: list[str] = []
        self.skipped: list[int] = []
        self.out: list[bytes] = []
        self.given = np.zeros(1 << 16, np.int64)

    def nodes(self, words: list[str], skipped: list[int]) -> range:
        """New nodes."""
        at = len(self.out)
        found, given = self.pieces.merge(words, np.array(skipped, np.uint64))
        self.out += found
        self.word += words
        self.skipped += skipped
        while len(self.out) > len(self.given):
            self.given = np.append(self.given, np.empty_like(self.given))
        self.given[at : len(self.out)] = given
        return range(at, len(self.out))

    def children_of(self, codes: list[int]) -> list[int]:
        """The nodes for each node << 6 | k that skips its candidate k as well."""
        new = [c for c in codes if c not in self.children]
        of = [c >> 6 for c in new]
        self.children.update(zip(new, self.nodes([self.word[i] for i in of], [self.skipped[i] | 1 << (c & 63) for c, i in zip(new, of)])))
        return [self.children[c] for c in codes]

    def encode(self, words: list[str], key: np.ndarray, dropout: float) -> list[bytes]:
        at = np.fromiter(map(self.roots.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        times = Counter(words[i] for i in fresh.tolist())
        again = [w for w, n in times.items() if n > 1]
        self.roots.update(zip(again, self.nodes(again, [0] * len(again))))
        at[fresh] = [self.roots.get(words[i], -1) for i in fresh.tolist()]

        live = np.flatnonzero(at >= 0) if dropout else np.empty(0, np.int64)
        k = 0
        while len(live := live[self.given[at[live]] > k]):
            hit = live[skips(key[live], k, dropout)]
            codes, of = np.unique(at[hit] << 6 | k, return_inverse=True)
            at[hit] = np.array(self.children_of(codes.tolist()), np.int64)[of]
            k += 1
        out = [self.out[i] if i >= 0 else b"" for i in at.tolist()]

        # A word that is met for the first time, and once, is merged for itself, and isn't kept.
        once = fresh[at[fresh] < 0]
        mask = np.zeros(len(once), np.uint64)
        for k in range(3 * max((len(words[i]) for i in once.tolist()), default=0)):
            mask |= skips(key[once], k, dropout).astype(np.uint64) << np.uint64(k)
        for i, found in zip(once.tolist(), self.pieces.merge([words[i] for i in once.tolist()], mask)[0]):
            out[i] = found
        return out


def encoder(path: str, dropout: float):
    """A function of words and their keys that gives each word's pieces, as bytes of 32-bit integers."""
    pieces = model(path)
    kept = [Outcomes(pieces)]

    def run(words: list[str], key: np.ndarray) -> list[bytes]:
        if len(kept[0].out) > KEPT:
            kept[0] = Outcomes(pieces)
        long = [i for i, w in enumerate(words) if len(w) > SHORT]
        short = words
        if long:
            short = words.copy()
            for i in long:
                short[i] = ""
        out = kept[0].encode(short, key, dropout)
        for i in long:
            out[i] = pieces.merge_long(words[i], skips(key[i], np.arange(3 * len(words[i])), dropout))
        return out

    return run


def prepared(text: str) -> str:
    return SPACE + text.replace(SPACE, ESCAPED).replace(" ", SPACE) if text else ""


def keys(doc_id: int | None, n: int, seed: int) -> np.ndarray:
    """The keys of the ``n`` words of a text."""
    return np.array(xxhash.xxh64_intdigest(str(doc_id), seed), np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


RESULT = "doc_id long, n_pieces long, pieces array<int>, lossless boolean"


def encode(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = 1) -> DataFrame:
    """Pieces of each text, and whether they decode to it (they always should).

    Takes (doc_id long, text string); other columns are ignored, whatever their names. Returns doc_id, n_pieces, pieces and
    lossless, a row for each input row, each by itself: rows that repeat get equal results, and texts that share a doc_id
    draw the same numbers. A null text is empty and has no pieces; a null doc_id draws as any other. Long texts, and long
    words, are encoded whole, in time n log n. An empty table gives no rows. ``path`` has to be there on every executor.
    """

    def run(batches):
        pieces, words_of = model(path), encoder(path, dropout)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                texts = [t or "" for t in b["text"].to_pylist()]
                words = [WORD.findall(prepared(t)) for t in texts]
                key = [keys(i, len(w), seed) for i, w in zip(b["doc_id"].to_pylist(), words)]
                every = words_of([x for w in words for x in w], np.concatenate(key))
                ends = np.cumsum([len(w) for w in words]).tolist()
                found = [np.frombuffer(b"".join(every[e - len(w) : e]), np.int32) for w, e in zip(words, ends)]
                lens = np.array([len(f) for f in found], np.int64)
                arrays = [
                    b["doc_id"].cast(pa.int64()),
                    pa.array(lens),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.array(np.concatenate(found))),
                    pa.array([pieces.decode(f.tolist()) == t for f, t in zip(found, texts)]),
                ]
                yield pa.record_batch(arrays, names=["doc_id", "n_pieces", "pieces", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, pieces); null pieces give an empty text."""

    def run(batches):
        pieces = model(path)
        for b in batches:
            texts = [pieces.decode(p or []) for p in b["pieces"].to_pylist()]
            yield pa.record_batch([b["doc_id"].cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "pieces").mapInArrow(run, "doc_id long, text string")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
