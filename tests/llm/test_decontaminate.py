import hashlib
import random
import re

import pytest

from trackloom.llm import decontaminate as m

from .conftest import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def cases():
    rnd = random.Random(1)
    vocab = ["The", "a", "of", "é", "x1", "rare", *(f"w{i}" for i in range(60))]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([3, 9, 10, 11, 30, 30, 1, 12])]
    items = [(i, " ".join(w)) for i, w in items] + [(20, None), (21, ""), (22, "..."), (23, "the the the the the the the the the the the"), (None, "null item words")]
    docs = []
    for i in range(80):
        w = text(rnd.randrange(30))
        if rnd.random() < 0.6:
            own = words(items[rnd.randrange(8)][1])
            at = rnd.randrange(len(own))
            w += own[at:] if rnd.random() < 0.5 else own
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w + text(rnd.randrange(8)))))
    docs += [(200, None), (201, ""), (202, "the " * 400), (None, items[4][1]), (203, "Null, ITEM. words")]
    return [*docs, docs[2], (docs[3][0], items[5][1])], items


def slow(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(10, len(iw))
        for s in range(len(iw) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(item)
    found = sorted(str(i) for i in found if i is not None)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [{}, {"BROADCAST_ROWS": 0}, {"BROADCAST_BYTES": 300}])
def test_equals_brute_force(spark, monkeypatch, most):
    for name, n in most.items():
        monkeypatch.setattr(f"trackloom.llm.common.{name}", n)
    docs, items = cases()
    table = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, h int, gram string")
    got = m.decontaminate(documents(spark, docs), table).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(((i, *slow(t, items)) for i, t in docs), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = m.clean(documents(spark, docs), table)
    assert "bucket" in kept.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in docs if not slow(t, items)[-1]), key=str)


def test_empty(spark):
    docs, items = cases()
    table = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in m.decontaminate(documents(spark, docs), table).collect()} == {False}
    assert m.decontaminate(documents(spark, []), table).collect() == []
