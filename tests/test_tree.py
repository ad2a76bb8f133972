import random

import pytest
from pyspark.sql import SparkSession

from trackloom.operators import tree


@pytest.fixture(scope="module")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def test_tree_finds_the_cheap_model(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        a, b = rnd.random(), rnd.random()
        right = "m0" if a < 0.5 else "m1" if b < 0.5 else "m2"
        rows.append((a, None if rnd.random() < 0 else b, *(0.1 if m == right else 1.0 for m in ("m0", "m1", "m2"))))
    rows += [(0.0, 0.0, 0.1, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 0.1)]
    models, features = ["m0", "m1", "m2"], ["a", "b"]
    df = tree.binned(spark.createDataFrame(rows, "a double, b double, m0 double, m1 double, m2 double"), features)
    grown = tree.fit(df, features, models, depth=3)
    assert grown[1]["feature"] == "a" and grown[1]["bin"] == 15 and grown[3]["feature"] == "b" and grown[3]["bin"] == 15
    got = tree.chosen(df, grown, features, models)
    assert got.selectExpr("avg(err)").first()[0] == pytest.approx(0.1)
    assert tree.fit(df.where("false"), features, models) == {}


def plain_tree(rows, n_features, n_models, depth, node=1, out=None):
    """The tree by trying every cut of every node."""
    out = {} if out is None else out
    cost = lambda rs: [sum(r[n_features + m] for r in rs) for m in range(n_models)]
    best = None
    for f in range(n_features):
        for b in sorted({r[f] for r in rows})[:-1]:
            left, right = [r for r in rows if r[f] <= b], [r for r in rows if r[f] > b]
            c = round(min(cost(left)) + min(cost(right)), 6)
            if best is None or c < best[0]:
                best = (c, f, b, left, right)
    if depth and best and best[0] < min(cost(rows)) - 1e-6:
        _, f, b, left, right = best
        out[node] = (f, b, cost(left).index(min(cost(left))), cost(right).index(min(cost(right))))
        plain_tree(left, n_features, n_models, depth - 1, 2 * node, out)
        plain_tree(right, n_features, n_models, depth - 1, 2 * node + 1, out)
    return out


def test_tree_depths_and_importance_equal_plain_ones(spark):
    rnd = random.Random(2)
    features, models = ["a", "b", "c"], ["m0", "m1", "m2", "m3"]
    rows = []
    for i in range(300):
        f = [rnd.randrange(8) for _ in features]
        rows.append((i, 1 + i % 2, i, *f, *(round(rnd.random() + abs(f[0] - 2 * m) + (f[1] > 3) * m, 3) for m in range(4))))
    df = spark.createDataFrame(rows, "track_id long, step long, k long, bin_a int, bin_b int, bin_c int, m0 double, m1 double, m2 double, m3 double").repartition(3)
    grown = tree.fit(df, features, models, depth=4)
    want = plain_tree([r[3:] for r in rows], 3, 4, 4)
    assert {n: (features.index(t["feature"]), t["bin"], models.index(t["left_model"]), models.index(t["right_model"])) for n, t in grown.items()} == want

    def leaf(f, depth):
        n, m = 1, 0
        while n in want and n.bit_length() <= depth:
            at, b, left, right = want[n]
            n, m = (2 * n, left) if f[at] <= b else (2 * n + 1, right)
        return m

    got = {(r["step"], r["depth"]): r["mean_err"] for r in tree.depth_scores(df, grown, features, models, 4).collect()}
    for step in (1, 2, None):
        of = [r for r in rows if step in (None, r[1])]
        assert got[step, 0] == pytest.approx(sum(min(r[6:]) for r in of) / len(of))
        for d in range(1, 5):
            assert got[step, d] == pytest.approx(sum(r[6 + leaf(r[3:6], d)] for r in of) / len(of))
    rise = {r["feature"]: r["rise"] for r in tree.importance(df, grown, features, models).where("step = 1").collect()}
    assert rise["a"] > rise["b"] > -0.05 and rise["a"] > 0.5 and abs(rise["c"]) < rise["a"]
    places = sorted(r["place"] for r in tree.importance(df, grown, features, models).where("step = 1").collect())
    assert places == [0, 1, 2]


def test_permutation_is_a_bijection(spark, monkeypatch):
    monkeypatch.setattr(tree, "RANGE", 20)
    rows = [(i, 1, i, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "track_id long, step long, k long, bin_a int, bin_b int").repartition(3)
    assert sorted(r["n"] for r in tree.ranked(df, 5, "n").collect()) == list(range(500))
    got = tree.permuted(df, ["bin_a", "bin_b"]).collect()
    assert sorted(r["dealt_bin_a"] for r in got) == list(range(500))
    assert all(r["dealt_bin_b"] == r["dealt_bin_a"] % 7 for r in got)
    assert sum(r["dealt_bin_a"] == r["bin_a"] for r in got) < 10
    moved = sorted(abs(r["dealt_bin_a"] - r["bin_a"]) for r in got)
    assert 100 < moved[250] < 200  # of a random permutation about 0.29 n
    assert tree.permuted(df.where("false"), ["bin_a"]).collect() == []


def test_bins_hold_about_as_many_rows(spark):
    rnd = random.Random(4)
    values = [rnd.gauss(0, 1) ** 9 for _ in range(4000)] + [1e12, None, float("nan")]
    df = spark.createDataFrame([(i, v, 2.0) for i, v in enumerate(values)], "i long, a double, b double").repartition(3)
    got = tree.sketched(df, ["a", "b"]).collect()
    counts = [sum(r["bin_a"] == b for r in got) for b in range(tree.BINS)]
    assert min(counts) > 80 and max(counts) < 180
    of = {r["i"]: r["bin_a"] for r in got}
    order = sorted((v, of[i]) for i, v in enumerate(values) if v is not None and v == v)
    assert [b for _, b in order] == sorted(b for _, b in order)
    assert of[4001] == of[4002] == -1 and {r["bin_b"] for r in got} == {0}
