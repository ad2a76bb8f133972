import math
import random

import numpy as np
import xxhash

from trackloom.llm import toxicity as m

from .conftest import documents


def cases(n=500):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(10, 80))]
        toxic, bad = rnd.random() < 0.2, rnd.random() < 0.2
        for at in rnd.sample(range(len(w)), 3):
            if toxic:
                w[at] = rnd.choice(["Awful,", "horrid", "VILE."])
        rows.append((i, " ".join(w + ["###", "junk"] * (3 * bad))))
        labels.append((i, int(not bad), int(toxic), "x"))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = cases()
    extra = [(9000, None), (9001, ""), (None, "vile awful horrid"), (9002, "w1 " * 50000), rows[3], (rows[4][0], "plain w2")]
    table = spark.createDataFrame(labels[:300] + [(None, 1, 0, "y"), (7777, None, 1, "z"), labels[0]], "doc_id long, quality int, toxic int, text string")
    df = documents(spark, rows + extra)
    chain = m.fit(df, table)
    got = m.score(df, chain).collect()
    assert len(got) == len(rows) + len(extra)
    of = {r["doc_id"]: r for r in got if r["doc_id"] != rows[4][0]}
    held = [(of[i]["toxic"], bool(t)) for i, _, t, _ in labels[300:]]
    assert np.mean([a == b for a, b in held]) >= 0.97
    assert of[None]["toxic"] and not of[9000]["toxic"] and not of[9001]["toxic"] and not of[9002]["toxic"]
    kept = m.without_toxic(df, chain)
    assert kept.columns == df.columns and kept.count() == sum(not r["toxic"] for r in got)


def test_later_links_use_earlier_ones():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 50, 10)).astype(np.int32) for _ in range(300)]
    first = np.array([3 in s for s in sets], float)
    chain = m.fit_chain(sets, np.column_stack([first, first]), np.arange(300) % 3)
    assert chain.weights[1][1 << m.BITS :][1] > 0.5  # the second model trusts the first
    p = chain.predict(m.Texts.of(sets))
    assert ((p[:, 0] > 0.5) == (first > 0)).all() and ((p[:, 1] >= chain.cuts[1]) == (first > 0)).mean() > 0.98


def test_cut():
    assert m.best_cut(np.array([0.9, 0.8, 0.3, 0.2]), np.array([1, 1, 0, 0])) == 0.55
    assert m.best_cut(np.array([0.2, 0.1]), np.array([0, 0])) == 0.5


def test_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = documents(spark, [(1, "a"), (2, None)])
    assert [r["toxic"] for r in m.score(df, m.fit(df, empty)).collect()] in ([False] * 2, [True] * 2)
    assert m.score(documents(spark, []), m.fit(df, empty)).collect() == []


def test_scores_equal_a_plain_chain(spark):
    """Every probability by hand: a text's distinct words, their weights, and the probabilities of the categories before."""
    rows, labels = cases(200)
    rows += [(9000, None), (9001, ""), (9002, "É-w1_W1 w1")]
    df = documents(spark, rows)
    chain = m.fit(df, spark.createDataFrame(labels[:150], "doc_id long, quality int, toxic int, text string"))
    size = 1 << m.BITS
    got = {r["doc_id"]: r for r in m.score(df, chain).collect()}
    for i, text in rows:
        plain = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text or "")
        words = {w.translate({k: k + 32 for k in range(65, 91)}) for w in plain.split(" ")} - {""}
        numbers = {xxhash.xxh64_intdigest(w.encode()) >> (64 - m.BITS) for w in words}
        before = []
        for name, w in zip(m.CHAIN, chain.weights):
            z = sum(w[n] for n in numbers) + w[size] + sum(a * b for a, b in zip(before, w[size + 1 :]))
            before.append(1 / (1 + math.exp(-z)))
            assert math.isclose(got[i][f"p_{name}"], before[-1], rel_tol=1e-9), (i, name)
        assert got[i]["toxic"] == (before[list(m.CHAIN).index("toxic")] >= chain.cuts[list(m.CHAIN).index("toxic")])
