import random
import re
from collections import Counter

from trackloom.llm import quality as m

from .conftest import documents


def rows():
    rnd = random.Random(1)
    words = ["the", "a", "##", "word", "longer", "é$", "12", "\U0001f600", "|", "-"]
    out = []
    for i in range(200):
        w = [rnd.choice(words[: rnd.randrange(2, 11)]) + str(rnd.randrange(rnd.choice([1, 3, 900]))) for _ in range(rnd.randrange(120))]
        out.append((i, "".join(x + rnd.choice([" ", " ", "\n", "\t", "\x0b", " ", "\x1c"]) for x in w)))
    lines = "same line here\n" * 30 + "\n \n"
    return [*out, (900, None), (901, ""), (902, "\n\n"), (903, lines), (904, "x" * 100000), (None, "a b c " * 40), out[3], (out[4][0], lines)]


def slow(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n = len(w)
    letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", x)) for x in w)
    out = (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
    base = n < 50 or 100 * len(again) > 50 * n
    more = 10 * out[2] > 3 * n or not 2 * n <= out[1] <= 14 * n or 2 * out[3] > len(lines) or 10 * letters < 7 * n
    return (*out, base, not (base or more))


def test_equals_brute_force(spark):
    got = sorted((tuple(r) for r in m.measures(documents(spark, rows())).collect()), key=str)
    assert got == sorted(((i, *slow(t)) for i, t in rows()), key=str)


def test_order_does_not_change_the_verdict(spark):
    df = documents(spark, rows())
    want = sorted(((i, slow(t)[-1]) for i, t in rows()), key=str)
    for rules in (list(m.RULES), list(m.RULES)[::-1], None):
        got = m.verdicts(df, rules).collect()
        assert sorted(((r["doc_id"], r["kept"]) for r in got), key=str) == want
        assert all((r["failed_rule"] is None) == r["kept"] for r in got)


def test_order_is_by_rejections_per_second(spark):
    figures = [("few_words", 1.0, 5), ("symbols", 0.1, 4), ("no_letters", 0.5, 5)]
    ranked = m.order([{"rule": r, "seconds": s, "rejected": n} for r, s, n in figures])
    assert ranked[:3] == ["symbols", "no_letters", "few_words"] and sorted(ranked) == sorted(m.RULES)
    measured = {r["rule"]: r for r in m.costs(documents(spark, rows()), sample=50)}
    assert set(measured) == set(m.RULES) and all(r["seconds"] > 0 and r["texts"] >= 50 for r in measured.values())


def test_cascade_stops_at_the_first_rejection():
    t = m.Text("a b")
    assert next(name for name in m.RULES if m.RULES[name](t)) == "few_words"
    assert "n_repeat_words" not in vars(t)


def test_empty(spark):
    assert m.measures(documents(spark, [])).collect() == []
