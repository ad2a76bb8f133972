import math
import random
import re
from collections import Counter

import pytest

from trackloom.llm import ranked_search as m

from .conftest import documents

TERM = re.compile(m.TERM)
ITEM = "item_id long, text string, doc_id long, terms string, class string"


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in TERM.findall(text or "")]


def cases():
    rnd = random.Random(3)
    vocab = ["The", "a", "of", "É", "é", "x1", "Rare", "naïve", *(f"w{i}" for i in range(40))]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 30))) for i in range(120)]
    docs += [(200 + i, docs[7][1]) for i in range(40)]  # more copies than are asked for
    docs += [(300 + i, " ".join(reversed(docs[9][1].split()))) for i in range(5)]  # same counts, other texts
    docs += [(400, None), (401, ""), (402, "..."), (403, "the " * 5000), (404, "zzz " + "unseen " * 9), (None, docs[7][1]), (5, text(9)), docs[11]]
    rnd.shuffle(docs)
    items = [(i, text(n)) for i, n in enumerate([1, 3, 9, 20, 30, 5])] + [(20, None), (21, ""), (22, "nowhere"), (3, "x1 rare"), (None, "naïve THE"), (23, docs[0][1])]
    return docs, items


def slow(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c in counted:
            norm = 100 - 50 + (50 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * norm)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i, s))
        out += [(item, r + 1, x[3], x[4]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def table(spark, items):
    return spark.createDataFrame([(*i, 7, "x", "y") for i in items], ITEM).repartition(2)


@pytest.mark.parametrize(("k", "change"), [(50, {}), (3, {}), (7, {"ITEMS": 3}), (5, {"CELLS": 64}), (20, {"ITEM_BYTES": 40})])
def test_equals_brute_force(spark, monkeypatch, k, change):
    for name, n in change.items():
        monkeypatch.setattr(m, name, n)
    docs, items = cases()
    got = m.search(documents(spark, docs), table(spark, items), k).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(docs, items, k)


def test_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("trackloom.llm.common.BROADCAST_ROWS", 0)
    docs, items = cases()
    got = m.search(documents(spark, docs), table(spark, items), 9).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(docs, items, 9)


def test_the_best_are_kept_whatever_the_order():
    import numpy as np

    rnd = np.random.default_rng(1)
    scores, docs = rnd.integers(0, 9, (3000, 4)), rnd.permutation(3000)
    best = m.Best(4, 20)
    for at in range(0, 3000, 50):
        best.add(scores[at : at + 50], np.arange(at, at + 50), docs[at : at + 50])
        if at % 500 == 0:
            best.prune()
    held = best.prune()
    for item in range(4):
        want = sorted((-scores[c, item], docs[c], c) for c in range(3000) if scores[c, item])[:20]
        assert [tuple(x) for x in held[1:, held[0] == item].T.tolist()] == [(-s, d, c) for s, d, c in want]


def test_empty(spark):
    docs, items = cases()
    assert m.search(documents(spark, []), table(spark, items)).collect() == []
    assert m.search(documents(spark, docs), table(spark, [])).collect() == []
    with pytest.raises(ValueError, match="k has to be"):
        m.search(documents(spark, docs), table(spark, items), 0)
