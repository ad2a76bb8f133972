import math
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow.parquet as pq
import pytest

from trackloom.llm.chunks import NULL_ID
from trackloom.llm.katz_lm import K, good_turing, held_out, katz, readable

from .conftest import documents


def brute(rows, order=2):
    """Katz by dictionaries, one document at a time."""
    docs = [(NULL_ID if i is None else i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    uni, grams = Counter(), {n: defaultdict(Counter) for n in range(2, order + 1)}
    for i, tokens in docs:
        if not held_out(i):
            uni.update(tokens)
            full = ["start", *tokens]
            for at in range(1, len(full)):
                for n in range(2, min(order, at + 1) + 1):
                    grams[n][tuple(full[at - n + 1 : at])][full[at]] += 1
    n, v = sum(uni.values()), len(uni)
    d1 = good_turing([sum(c == r for c in uni.values()) for r in range(1, K + 2)])[0]
    dn = {k: good_turing([sum(c == r for x in g.values() for c in x.values()) for r in range(1, K + 2)])[0] for k, g in grams.items()}
    d = lambda x, c: x[c] if c <= K else 1
    mass = sum(d(d1, c) * c for c in uni.values())
    scale = n if mass < n else n + 1
    unknown = 1 - mass / scale if n else 1.0
    p1 = lambda w: d(d1, uni[w]) * uni[w] / scale if uni[w] else unknown

    @cache
    def p(w, context):
        if not context:
            return p1(w)
        below = (lambda x: float(np.float32(p(x, context[1:])))) if len(context) > 1 else p1
        seen = grams[len(context) + 1].get(context)
        if not seen:
            return below(w)
        total = sum(seen.values())
        total += all(c > K for c in seen.values())
        discount = dn[len(context) + 1]
        if seen[w]:
            return d(discount, seen[w]) * seen[w] / total
        left = 1 - sum(d(discount, c) * c for c in seen.values()) / total
        return left / (1 - sum(below(x) for x in seen if seen[x])) * below(w)

    for g in grams.values():  # normalised over all words and the unknown one
        for context in list(g)[:40]:
            assert math.isclose(sum(p(w, context) for w in [*uni, "never"]), 1, rel_tol=1e-9 if len(context) < 2 else 1e-5)
    out = []
    for i, tokens in docs:
        base = sum(math.log10((uni[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        full = ["start", *tokens]
        score = sum(math.log10(p(full[at], tuple(full[max(0, at - order + 1) : at]))) for at in range(1, len(full)))
        out.append((None if i == NULL_ID else i, held_out(i), len(tokens), sum(uni[t] > 0 for t in tokens), n, base, score))
    return out


def rows():
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))) for i in range(150)]
    out += [(200 + i, "the same Pair of words " * 8) for i in range(30)]
    out += [(400, None), (401, ""), (402, " \n\t "), (None, "a null id"), (7, out[7][1]), (7, "shared id")]
    return out


def same(got, want):
    key = lambda r: tuple(str(x) for x in r[:5]) + (round(r[5], 6), round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("order", "share"), [(1, 1 / 1024), (2, 1 / 1024), (2, 0.02), (3, 1 / 1024), (3, 0.002), (4, 0.002)])
def test_equals_brute_force(spark, monkeypatch, order, share):
    monkeypatch.setattr("trackloom.llm.katz_lm.HOT_SHARE", share)
    same(katz(documents(spark, rows()), order).scores.collect(), brute(rows(), order))


def test_tables_can_be_read(spark):
    docs = [(NULL_ID if i is None else i, ["start", *(t or "").encode().lower().split(), None]) for i, t in rows()]
    docs = [t for i, t in docs if not held_out(i)]
    for n, table in enumerate(katz(documents(spark, rows()), 3).tables, 1):
        want = Counter(Counter(tuple(t[at - n + 1 : at + 1]) for t in docs for at in range(1, len(t)) if at >= n - 1).values())
        got = readable(table, n).where("count > 0").groupBy("count").count().collect()
        assert {r[0]: r[1] for r in got} == want


def test_small_chunks_give_the_same(spark, monkeypatch):
    import trackloom.llm.katz_lm as m

    real = m.chunk_table
    monkeypatch.setattr(m, "chunk_table", lambda *a, **k: real(*a, **k | {"tokens": 50}))
    same(katz(documents(spark, rows()), 3).scores.collect(), brute(rows(), 3))


def test_without_training_documents(spark):
    held = [i for i in range(100) if held_out(i)][:2]
    got = katz(documents(spark, [(i, "a b") for i in held])).scores.collect()
    assert [(r["n_tokens"], r["n_known"], r["score"]) for r in got] == [(3, 0, 0.0)] * 2


def test_empty(spark):
    assert katz(documents(spark, [])).scores.collect() == []


def test_discounts_follow_the_line():
    n = [round(1e6 / r**2.5) for r in range(1, K + 2)]
    d, method = good_turing(n)
    common = 6**-1.5
    assert method == "good-turing"
    assert d[1:] == pytest.approx([((1 + 1 / r) ** -1.5 - common) / (1 - common) for r in range(1, K + 1)], rel=2e-3)


def test_raw_estimates_hold_while_they_differ_from_the_line():
    n = [100_000, 20_000, 9_000, 5_000, 3_300, 2_300]
    slope = np.polyfit(np.log(range(1, 7)), np.log(n), 1)[0]
    common, (d, method) = 6 ** (slope + 1), good_turing(n)
    raw = [(r + 1) * n[r] / n[r - 1] / r for r in range(1, 6)]
    line = [(1 + 1 / r) ** (slope + 1) for r in range(1, 6)]
    apart = [abs(a - b) > 1.96 * (r + 1) / r * n[r] / n[r - 1] * math.sqrt(1 / n[r] + 1 / n[r - 1]) for r, a, b in zip(range(1, 6), raw, line, strict=True)]
    first = apart.index(False) if False in apart else K
    assert method == "good-turing" and first > 0
    assert d[1:] == pytest.approx([((a if i < first and common < a < 1 else b) - common) / (1 - common) for i, (a, b) in enumerate(zip(raw, line, strict=True))])


def test_sparse_and_flat_counts():
    assert good_turing([0, 0, 0, 0, 0, 0]) == (pytest.approx(np.array([1, 0.5, 0.75, 5 / 6, 0.875, 0.9])), "absolute")
    assert good_turing([5, 5, 5, 5, 5, 5])[1] == "absolute"
    for n in ([40, 0, 3, 0, 0, 1], [9, 4, 0, 0, 0, 0], [7, 9, 2, 3, 1, 0]):
        d, method = good_turing(n)
        assert ((d[1:] > 0) & (d[1:] < 1)).all(), (n, d, method)
    assert good_turing([40, 0, 3, 0, 0, 1])[1] == "good-turing"


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_given_tables_are_discounted_by_good_turing(size):
    rows = pq.read_table(f"/root/testdata/{size}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    words, pairs = Counter(), Counter()
    for r in rows:
        if not held_out(r["doc_id"]):
            tokens = [*(r["text"] or "").encode().lower().split(), None]
            words.update(tokens)
            pairs.update(zip(["start", *tokens], tokens, strict=False))
    for counts in (words, pairs):
        n = [sum(c == r for c in counts.values()) for r in range(1, K + 2)]
        d, method = good_turing(n)
        assert method == "good-turing", n
        assert ((d[1:] > 0.1) & (d[1:] < 0.95)).all(), (n, d)
