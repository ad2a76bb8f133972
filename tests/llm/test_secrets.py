import hashlib
import random
import re
import string
import time

from trackloom.llm import secrets as m

from .conftest import documents

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def base(text):
    found = []
    for rank, (kind, (p, group, least)) in enumerate(PATTERNS.items()):
        found += [(x.start(), rank, x.end(), kind) for x in p.finditer(text or "") if len(x[group]) >= least]
    return [(s, k, e) for s, _, e, k in sorted(found)]


def rows():
    rnd = random.Random(1)
    text = lambda n, a: "".join(rnd.choice(a) for _ in range(n))
    letters = string.ascii_letters + string.digits
    words = ["the", "ordinary", "identifiers", "getElementById", "configuration_of_things", "é", "\U0001f600", "pass", "secret", "token", "="]
    out = []
    for i in range(120):
        parts = [rnd.choice(words) for _ in range(rnd.randrange(40))]
        for _ in range(rnd.randrange(4)):
            parts.append(
                rnd.choice(
                    [
                        f'Password = "{text(rnd.randrange(4, 20), letters)}"',
                        f"api_key:{text(14, letters)}",
                        "AKIA" + text(rnd.randrange(14, 20), string.ascii_uppercase + string.digits),
                        "AKIAAKIA" + text(rnd.randrange(8, 16), string.ascii_uppercase),
                        text(rnd.randrange(20, 60), "0123456789abcdef"),
                        "token: token: abcdef1",
                        "SECRET=TOKEN=x' secret='AKIA" + text(20, string.ascii_uppercase) + "'",
                    ]
                )
            )
        rnd.shuffle(parts)
        out.append((i, rnd.choice([" ", "\n", "\U0001f600"]).join(parts)))
    out += [(500, None), (501, ""), (502, "ſecret=abcdefgh Apiſkey=abcdefgh"), (None, "secret=abcdefgh"), (503, "x " * 30000 + "token=" + "a1" * 20)]
    return [*out, out[3], (out[4][0], "passwd:abcdef")]


def test_base_spans_equal_regular_expressions(spark):
    got = m.scan(documents(spark, rows())).collect()
    assert len(got) == len(rows())
    have = sorted(((r["doc_id"], r["text"], [tuple(s) for s in r["secrets"] if s["kind"] != "markov"]) for r in got), key=str)
    assert have == sorted(((i, t, base(t)) for i, t in rows()), key=str)


def test_models_tell_random_strings_from_identifiers(spark):
    rnd = random.Random(2)
    letters = string.ascii_letters + string.digits
    unnamed = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(24, 44))) for _ in range(60)]
    syllables = ["con", "fig", "ura", "tion", "man", "ager", "fac", "tory", "han", "dler", "re", "quest", "_"]
    plain = ["".join(rnd.choice(syllables) for _ in range(9))[:40] for _ in range(60)]
    ident = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(3, 9)))
    value = lambda: "".join(rnd.choice(letters) for _ in range(30))
    train = [(i, " ".join(ident() for _ in range(20)) + f" api_key={value()}") for i in range(300)]
    model = m.fit(documents(spark, train))
    test = [(i, f"here {w} ends") for i, w in enumerate(unnamed + plain)]
    got = {r["doc_id"]: [tuple(s) for s in r["secrets"]] for r in m.scan(documents(spark, test), model).collect()}
    hits = [got[i] == [(5, "markov", 5 + len(w))] for i, w in enumerate(unnamed) if not base(w)]
    assert sum(hits) >= 0.95 * len(hits)
    assert sum(bool(got[60 + i]) for i in range(60)) <= 2


def test_ratio_is_the_sum_over_pairs(spark):
    model = [((i * 7919) % 101 - 50) / 10 for i in range(len(m.ALPHABET) ** 2)]
    words = ["a", "ab", "Zz09+/=_-", "aAaA" * 9]
    got = spark.createDataFrame([(w,) for w in words], "word string")
    got = got.select("word", m.ratio(got["word"], model).alias("r")).collect()
    for r in got:
        at = [m.ALPHABET.index(c) for c in r["word"]]
        want = sum(model[a * len(m.ALPHABET) + b] for a, b in zip(at, at[1:]))
        assert abs(r["r"] - want) < 1e-9


def test_redact_and_digest(spark):
    df = m.scan(documents(spark, rows()))
    for r in df.withColumn("clean", m.redact(df)).withColumn("listed", m.listed(df["secrets"])).collect():
        t, at, out = r["text"] or "", 0, ""
        for s, _, e in r["secrets"]:
            if s >= at:
                out += t[at:s] + "[secret]"
            at = max(at, e)
        assert (r["clean"] or "") == out + t[at:]
        assert r["listed"] == ",".join(f"{k}:{s}:{e}" for s, k, e in r["secrets"])
        assert not [x for x in base(r["clean"]) if x[1] != "assign"]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_empty(spark):
    assert m.scan(documents(spark, [])).collect() == []


def test_many_matches_take_no_square_of_their_number(spark):
    rnd = random.Random(5)
    digits = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(24))
    text = " ".join(rnd.choice(["x", "secret=abcdefg", "AKIA" + "A" * 16]) + "\U0001f600" + digits() for _ in range(100_000))
    df = m.scan(documents(spark, [(1, text), (2, "z" * 3000 + " token=abcdefgh " + "y" * 3000)]), [0.0] * len(m.ALPHABET) ** 2)
    began = time.monotonic()
    one, two = df.withColumn("clean", m.redact(df)).orderBy("doc_id").collect()
    assert time.monotonic() - began < 60
    assert [tuple(s) for s in one["secrets"]] == base(text)
    assert one["clean"] == re.sub(r"secret=abcdefg|AKIAA{16}|[0-9a-f]{24}", "[secret]", text)
    assert two["clean"] == "z" * 3000 + " [secret] " + "y" * 3000


def test_overlaps_and_running_folds(spark):
    rnd = random.Random(6)
    rows_ = []
    for _ in range(200):
        cuts = sorted(rnd.sample(range(400), 2 * rnd.randrange(60)))
        rows_.append((list(zip(cuts[::2], cuts[1::2])), [(a, a + rnd.randrange(1, 20)) for a in (rnd.randrange(400) for _ in range(rnd.randrange(8)))]))
    span = lambda x: [(a, 0, b, "w") for a, b in x]
    df = spark.createDataFrame([(span(c), span(k), [b - a for a, b in c]) for c, k in rows_], f"c array<{m.SPAN}>, k array<{m.SPAN}>, n array<int>")
    total = m.running(df["n"], lambda a, b: a + b)
    for (c, k), r in zip(rows_, df.select(m.free(df["c"], df["k"]).alias("f"), total.alias("t")).collect()):
        assert [(s["start"], s["stop"]) for s in r["f"]] == [x for x in c if not any(a < x[1] and x[0] < b for a, b in k)]
        assert r["t"] == [sum(b - a for a, b in c[:i]) for i in range(len(c))]


def test_held_out_precision_and_recall(spark):
    """The default models, on words of documents outside the sample and strings of another generator."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = m.fit(docs)
    rnd = random.Random(7)
    forms = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF", string.ascii_uppercase + string.digits]
    secret = ["".join(rnd.choice(a) for _ in range(rnd.randrange(24, 48))) for a in forms for _ in range(100)]
    parts = ["get", "Element", "By", "configuration", "_of_", "things", "request", "Handler", "manager", "-factory", "/usr/local/", "share/", "documents", "version"]
    plain = ["".join(rnd.choice(parts) for _ in range(9))[:44] for _ in range(400)]
    test = [(i, f"x {w} y") for i, w in enumerate(secret + plain)]
    got = {r["doc_id"]: any(s["kind"] == "markov" for s in r["secrets"]) for r in m.scan(documents(spark, test), model).collect()}
    caught, wrong = sum(got[i] for i in range(400)), sum(got[400 + i] for i in range(400))
    print("caught", caught, "of 400, wrong", wrong)
    assert caught >= 380 and wrong <= 8
