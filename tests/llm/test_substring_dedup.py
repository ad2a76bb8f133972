import hashlib
import random

import pytest

from trackloom.llm.substring_dedup import dedup_substrings, levels

from .conftest import documents


def brute(rows, window):
    docs = [(i, [*(t or "").encode().split()]) for i, t in rows]
    key = lambda i, s: (-1 if i is None else i, s)
    first = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, (1 << 60, 0)), key(i, s))
    out = []
    for i, w in docs:
        gone = {
            p
            for s in range(len(w) - window + 1)
            if first[tuple(w[s : s + window])] < key(i, s)
            for p in range(s, s + window)
        }
        left = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest(), left.decode()))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = [text(n) for n in (19, 20, 21, 60)]
    out = []
    for i in range(80):
        parts = text(rnd.randrange(40))
        for _ in range(rnd.randrange(3)):
            parts += rnd.choice(shared) + text(rnd.randrange(6))
        out.append((100 - i, " ".join(parts)))
    out += [(300 + i, " ".join(shared[3])) for i in range(20)]
    out += [(500, "a " * 90), (501, None), (502, ""), (503, "x\t\ny é"), (None, " ".join(shared[3]))]
    return [*out, out[5], (out[6][0], " ".join(shared[2]))]


@pytest.mark.parametrize("window", [1, 3, 7, 20, 25])
def test_equals_brute_force(spark, window):
    got = [tuple(r) for r in dedup_substrings(documents(spark, rows()), window).collect()]
    assert sorted(got, key=str) == brute(rows(), window)


def test_small_chunks_give_the_same(spark, monkeypatch):
    import trackloom.llm.substring_dedup as m

    real = m.chunk_table
    monkeypatch.setattr(m, "chunk_table", lambda *a, **k: real(*a, **k, tokens=100))
    got = [tuple(r) for r in dedup_substrings(documents(spark, rows())).collect()]
    assert sorted(got, key=str) == brute(rows(), 20)


def test_empty(spark):
    assert dedup_substrings(documents(spark, [])).collect() == []


def test_levels():
    assert levels(20) == [5, 10, 20] and levels(25) == [4, 7, 13, 25] and levels(3) == [3]
