import random
from itertools import combinations

import pytest
import xxhash

from trackloom.llm.common import Workspace
from trackloom.llm.components import components
from trackloom.llm.simhash import fingerprint, links, masks, near_duplicates

from .conftest import documents


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def slow(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)) if hs else 0


def test_fingerprint():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["A", "b", "É", "dd"]) for _ in range(rnd.randrange(40))) for _ in range(60)]
    for t in [None, "", " \n", "one", "one Two", *texts, "x y " * 20000]:
        assert fingerprint(t, 3) % (1 << 64) == slow(t)


def test_masks_cover():
    for radius in (2, 4):
        every = [m % (1 << 64) for m in masks(radius)]
        rnd = random.Random(2)
        tuples = combinations(range(64), 2) if radius == 2 else (rnd.sample(range(64), radius) for _ in range(3000))
        for bits in tuples:
            assert any(not any(m >> b & 1 for b in bits) for m in every)


@pytest.mark.parametrize("compared", [1, 3, 16])
def test_links_are_the_pairs_within_the_radius(spark, monkeypatch, compared):
    monkeypatch.setattr("trackloom.llm.simhash.PAIRS", compared)
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1, *centres}
    for _ in range(400):
        x = rnd.choice(sorted(fps))
        for b in rnd.sample(range(64), rnd.randrange(1, 4)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    got = links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()
    pairs = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 for r in got)
    assert roots(signed, pairs) == roots(signed, [(r.a, r.b) for r in got])


def test_components(spark, tmp_path):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)]
    pairs += [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(120)] + [(7, 7), (3, 4)]
    df = spark.createDataFrame([rnd.sample(p, 2) for p in pairs] + [(None, 5)], "a long, b long")
    got = {r.node: r.root for r in components(df, Workspace(spark, "t")).collect()}
    want = roots({n for p in pairs for n in p}, pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}


def test_near_duplicates(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(5, 400))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (None, "alone null"), (None, " ".join(base[0]))]
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((500 - i, " ".join(w)))
    rows += [rows[-1], (rows[-2][0], "another text")]
    fps = [fingerprint(t, 3) for _, t in rows]
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if ((fps[a] ^ fps[b]) % (1 << 64)).bit_count() <= 2]
    root = roots(range(len(rows)), near)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = sorted(((i, fps[k], least.get(root[k])) for k, (i, _) in enumerate(rows)), key=str)
    got = sorted((tuple(r) for r in near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == want
    assert near_duplicates(documents(spark, [])).collect() == []
