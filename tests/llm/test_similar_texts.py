import random
from itertools import combinations

import pytest

from trackloom.llm.similar_texts import one_of_each

from trackloom.llm.simhash import fingerprint

from .conftest import documents
from .test_simhash import roots


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (None, "alone null"), (900, "a b"), (901, "A  b"), (902, "a c")]
    for i in range(8):
        base = [rnd.choice(words) for _ in range(rnd.randrange(150, 400))]
        for j in range(12):
            w = list(base)
            for _ in range(j % 3):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((10 * j + i, " ".join(w)))
    rows += [rows[-1], (None, rows[-1][1])]

    def close(a, b):
        return len(a & b) >= 0.8 * len(a | b)

    sets = [grams(t) for _, t in rows]
    root = roots(range(len(rows)), [(a, b) for a, b in combinations(range(len(rows)), 2) if close(sets[a], sets[b])])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], 10**6), 10**6 if i is None else i)
    got = one_of_each(documents(spark, rows)).collect()
    assert sorted(10**6 if r.doc_id is None else r.doc_id for r in got) == sorted(least.values())
    assert len(got[0]) == 7 and one_of_each(documents(spark, [])).collect() == []


@pytest.mark.parametrize("place", [0, 60, 120])
def test_copies_linked_only_through_their_original(spark, place):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(120):
        w = list(base)
        for at in rnd.sample(range(40), 7):
            w[10 * at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    texts.insert(place, " ".join(base))
    sets = [grams(t) for t in texts]
    close = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(roots(range(len(texts)), close).values()) == {0} and all(place in p for p in close)
    assert [r.doc_id for r in one_of_each(documents(spark, list(enumerate(texts)))).collect()] == [0]


def test_every_similar_pair_is_linked(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(60):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(100, 600))]
        cut = base[: int(len(base) * rnd.choice([0.95, 0.9, 0.85, 0.81]))]
        longer = base + [f"y{rnd.randrange(10**6)}" for _ in range(len(base) // rnd.randrange(5, 20))]
        edited = list(base)
        for _ in range(len(base) // rnd.randrange(30, 60)):
            edited[rnd.randrange(len(base))] = f"x{rnd.randrange(10**6)}"
        rows += [(i, " ".join(base)), (100 + 2 * i, " ".join(rnd.choice([cut, longer]))), (101 + 2 * i, " ".join(edited))]
    sets = [grams(t) for _, t in rows]
    close = [(a, b) for a, b in combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(range(len(rows)), close)
    assert 60 < len(set(root.values())) < 100
    got = one_of_each(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows[k][0] for k in set(root.values()))


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    rnd = random.Random(13)
    repeated = " ".join(f"r{i}" for i in range(21)) + " "
    texts = [repeated * 40 + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(4)] + [" ".join(f"v{rnd.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    sets = [grams(t) for t in texts]
    assert not [(a, b) for a, b in combinations(range(10), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    fps = [fingerprint(t, 3) for t in texts]
    root = roots(range(10), [(a, b) for a, b in combinations(range(10), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert len(set(root.values())) == 7
    assert sorted(r.doc_id for r in one_of_each(documents(spark, list(enumerate(texts)))).collect()) == sorted(set(root.values()))
