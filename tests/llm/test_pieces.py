import random
import time

import numpy as np
import sentencepiece

from trackloom.llm import pieces as m

from .conftest import documents


def rows():
    rnd = random.Random(1)
    words = ["the", "Tokenization", "naïve", "  ", "a\nb", "\t", "\U0001f600", "ﬁ", "▁", "▁x", "x▁", "0123456789" * 9, "ciónadora", "zzzzzzzz", ""]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(30)))) for i in range(150)]
    return [*out, (900, None), (901, ""), (902, " "), (903, " a"), (905, "x      y" + " " * 25 + "z"), (904, "q" * 5000), (None, "null id"), out[3], (out[4][0], "other")]


def slow(word, key, dropout):
    """One word by looking at all neighbours again after each candidate; pieces and scores from the library itself."""
    sp = sentencepiece.SentencePieceProcessor(model_file=m.MODEL)
    full = (1 << 64) - 1
    parts, number, skipped = [(i, c) for i, c in enumerate(word)], 0, set()
    while True:
        open_ = []
        for k, ((i, a), (_, b)) in enumerate(zip(parts, parts[1:])):
            new = sp.unk_id() if m.ESCAPED in a + b else sp.piece_to_id(a + b)
            if new != sp.unk_id() and not sp.is_byte(new) and (i, a + b) not in skipped and (len(a) == 1 or sp.piece_to_id(a)):
                open_.append((-sp.get_score(new), k, i, a + b))
        if not open_:
            return [p for _, p in parts]
        _, k, i, join = min(open_)
        h = key + (number + 1) * 0x9E3779B97F4A7C15 & full
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        number += 1
        if ((h ^ h >> 31) >> 11) / (1 << 53) < dropout:
            skipped.add((i, join))
        else:
            parts[k : k + 2] = [(i, join)]


def test_without_dropout_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=m.MODEL)
    plain = [(i, t) for i, t in rows() if "▁" not in (t or "")]
    got = m.encode(documents(spark, plain), dropout=0.0).collect()
    want = sorted(((i, sp.encode(t or "")) for i, t in plain), key=str)
    assert sorted(((r["doc_id"], list(r["pieces"])) for r in got), key=str) == want


def test_dropout_is_lossless_and_varied(spark):
    df = documents(spark, rows())
    seen = {}
    for seed in (1, 2):
        found = m.encode(df, dropout=0.3, seed=seed)
        got = found.collect()
        assert len(got) == len(rows()) and all(r["lossless"] and r["n_pieces"] == len(r["pieces"]) for r in got)
        assert sorted(got, key=str) == sorted(m.encode(df.repartition(1), dropout=0.3, seed=seed).collect(), key=str)
        back = sorted((tuple(r) for r in m.decode(found).collect()), key=str)
        assert back == sorted(((i, t or "") for i, t in rows()), key=str)
        seen[seed] = sorted(map(str, got))
    assert seen[1] != seen[2]


def spelled(pieces, found):
    return b"|".join(pieces.bytes[p] for p in memoryview(found).cast("i"))


def test_words_equal_a_plain_agenda():
    pieces, rnd = m.model(m.MODEL), random.Random(2)
    words = sorted({w for _, t in rows() for w in m.WORD.findall(m.prepared(t or "")) if len(w) < 200})
    words = [rnd.choice(words) for _ in range(150)] + words
    key = np.array([rnd.getrandbits(64) for _ in words], np.uint64)
    for dropout in (0.0, 0.1, 0.5, 0.95):
        encode = m.encoder(m.MODEL, dropout)
        for _ in range(2):  # the second time from what the first has kept
            got = [spelled(pieces, f) for f in encode(words, key)]
            for w, k, g in zip(words, key.tolist(), got):
                want = [p if p in pieces.id else [bytes([b]) for b in ("▁" if p == m.ESCAPED else p).encode()] for p in slow(w, k, dropout)]
                want = [x for p in want for x in ([p.replace("▁", " ").encode()] if isinstance(p, str) else p)]
                assert g == b"|".join(want), (w, dropout)


def test_occurrences_differ(spark):
    rows_ = m.encode(documents(spark, [(i, "internationalization " * 50) for i in range(4)]), dropout=0.2).collect()
    pieces = m.model(m.MODEL)
    ways = {w for r in rows_ for w in " ".join(pieces.bytes[p].decode() for p in r["pieces"]).split("  ")}
    assert len(ways) > 40 and len({tuple(r["pieces"]) for r in rows_}) == 4


def test_share_of_skips():
    found = m.skips(np.arange(20_000, dtype=np.uint64) << np.uint64(20), 3, 0.1)
    assert 0.09 < found.mean() < 0.11 and not m.skips(np.arange(9, dtype=np.uint64), 0, 0.0).any()


def test_long_words_take_no_square_of_their_length(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh") for _ in range(300_000))
    began = time.monotonic()
    r = m.encode(documents(spark, [(1, text)])).first()
    assert r["lossless"] and time.monotonic() - began < 30


def test_all_dropped_leaves_characters(spark):
    r = m.encode(documents(spark, [(1, "abc abc")]), dropout=1.0).first()
    assert r["n_pieces"] == 8 and r["lossless"]


def test_empty(spark):
    assert m.encode(documents(spark, [])).collect() == []
