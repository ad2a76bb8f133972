import math
import random
import re
import time

import numpy as np
import pytest

from trackloom.llm import language as m

from .conftest import documents

LANGS = ["aa", "bb"]


def text(rnd, lang, n=30):
    return " ".join("".join(rnd.choice("xyz" if lang == "aa" else "uvw") for _ in range(5)) for _ in range(n))


def page_table(spark, pages):
    return spark.createDataFrame([(*p, 1, "q") for p in pages], "page_id long, url string, html string, own int, host string")


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, LANGS[i % 2]), LANGS[i % 2], "s", 1) for i in range(40)] + [(None, "x", "aa", "s", 1), (50, None, "bb", None, 1), (51, "", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, *m.fit_text(docs)


@pytest.mark.parametrize("rows_", [100_000, 0])
def test_equals_brute_force(spark, fitted, monkeypatch, rows_):
    """Whether the keys' tables are broadcast or not, some hot and some not."""
    monkeypatch.setattr("trackloom.llm.common.BROADCAST_ROWS", rows_)
    monkeypatch.setattr("trackloom.llm.common.HOT", 4)
    docs, langs, model = fitted
    assert langs == LANGS
    rnd = random.Random(2)
    pages = []
    for i in range(60):
        lang = LANGS[rnd.random() < 0.3]
        host = rnd.choice(["a.site.com", "b.site.com", "other.org", "www.third.de"])
        html = rnd.choice([f'<html lang="{lang}">', "<html>", '<html lang="cc">']) + "<script>uvw uvw</script><p>" + text(rnd, lang, rnd.randrange(4)) + "</p>"
        pages.append((i, f"https://{host}/{lang}/x{i}", html))
    pages += [(100, None, None), (101, "", ""), (None, "http://a.site.com", "<p>xyzxy"), pages[0], (pages[1][0], "nonsense", "<p>uvwuv")]
    rows = m.page_rows(page_table(spark, pages)).unionByName(m.document_rows(docs))
    seen = [r.asDict() for r in m.text_evidence(rows, langs, model).collect()]
    total = [sum(r["own"] == k for r in seen) for k in (1, 2)]
    want = []
    for r in seen:
        score = []
        for k in (1, 2):
            same = lambda by: sum(x["own"] == k for x in seen if x[by] == r[by])
            s = r["loglik"][k - 1] + sum(math.log((same(by) + 0.5) / (total[k - 1] + 1)) for by in ("declared", "suffix") if r[by] is not None)
            p = (total[k - 1] + 1) / (sum(total) + 2)
            for near in ([x for x in seen if x["domain"] == r["domain"]], [x for x in seen if (x["domain"], x["host"]) == (r["domain"], r["host"])]):
                n = sum(x["own"] > 0 for x in near) - (r["own"] > 0)
                p = (sum(x["own"] == k for x in near) - (r["own"] == k) + m.PRIOR_ROWS * p) / (n + m.PRIOR_ROWS)
            score.append(s + math.log(p))
        best = int(np.argmax(score))
        want.append((r["doc_id"], r["page_id"], langs[best], round(1 / sum(math.exp(s - max(score)) for s in score), 9), langs[r["own"] - 1] if r["own"] else None))
    got = [(*r[:3], round(r[3], 9), r[4]) for r in m.identify(rows, langs, model).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_declared_language_decides_a_page_without_text(spark, fitted):
    _, langs, model = fitted
    rnd = random.Random(3)
    pages = [(i, "http://h.com/", f'<html lang="{LANGS[i % 2]}"><p>{text(rnd, LANGS[i % 2])}') for i in range(40)]
    pages += [(90, "http://h.com/", '<html lang="bb">'), (91, "http://h.com/", '<html lang="aa">')]
    got = {r["page_id"]: r for r in m.identify(m.page_rows(page_table(spark, pages)), langs, model).collect()}
    assert all(got[i]["lang"] == LANGS[i % 2] for i in range(40))
    assert (got[90]["lang"], got[91]["lang"], got[90]["text_lang"]) == ("bb", "aa", None)


def test_empty(spark, fitted):
    docs, langs, model = fitted
    assert m.identify(m.page_rows(page_table(spark, [])), langs, model).collect() == []
    empty = documents(spark, [])
    assert m.fit_text(empty)[0] == []
    assert m.identify(m.document_rows(docs), [], model).count() == docs.count()


def test_text_model_equals_counts(spark):
    rnd = random.Random(4)
    rows = [(i, text(rnd, LANGS[i % 2], 5), LANGS[i % 2], "s", 1) for i in range(8)] + [(8, "é x", "bb", "s", 1), (9, None, "aa", "s", 1), (None, "zzz", "aa", "s", 1)]
    langs, model = m.fit_text(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for k, lang in enumerate(langs):
        n = [0.5] * (1 << m.BITS)
        for i, t, of, *_ in rows:
            data = f" {t} ".encode() if i is not None and t is not None and of == lang else b""
            for a, b, c in zip(data, data[1:], data[2:]):
                n[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> (32 - m.BITS)] += 1
        assert np.allclose([model.loglik(np.array([c]))[k] for c in range(0, 1 << m.BITS, 97)], np.log(np.array(n) / sum(n))[::97])
        assert np.isclose(model.loglik(np.arange(1 << m.BITS).repeat(2))[k], 2 * np.log(np.array(n) / sum(n)).sum())


def test_every_language_is_learnt(spark):
    rnd = random.Random(6)
    rows = [(i, text(rnd, "aa"), "aa", "s", 1) for i in range(3000)] + [(9000, text(rnd, "bb"), "bb", "s", 1)]
    rows += [(10_000 + i, " ".join(chr(0x4E00 + 10 * i + rnd.randrange(10)) * 3 for _ in range(40)), f"x{i:03}", "s", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    langs, model = m.fit_text(docs)
    assert len(langs) == 152
    got = {r["doc_id"]: r for r in m.identify(m.document_rows(docs), langs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text_lang"] == lang for i, _, lang, *_ in rows)


def test_markup_like_patterns():
    slow = re.compile(r"(?si)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")
    rnd = random.Random(8)
    parts = ["<!--", "-->", "--", "<script", "<SCRIPT>", "</script>", "</script >", "<style ", "</style", ">", "<", "<p>", "x", " ", "a>b", "<scripty>", "</Style>"]
    for _ in range(4000):
        html = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        assert m.bare(html) == slow.sub(" ", html), html


@pytest.mark.parametrize("part", ["<script ", "<!-- ", "<style>", "<", "<html lang", "</script", "<!--<script>"])
def test_broken_pages_take_time_in_proportion(part):
    began = time.perf_counter()
    m.bare(part * 300_000)
    assert time.perf_counter() - began < 5


def test_page_rows(spark):
    pages = [
        (1, "https://user@www.Site.co.DE:80/fr/x?q", "<HTML class=x lang='DE-at'>"),
        (2, "http://site.com/fra/x", "<html>"),
        (3, None, None),
        (4, "no address", '<p lang="de">'),
        (5, "ftp://host/en", '<html lang=x>'),
    ]
    got = {r["page_id"]: (r["declared"], r["suffix"], r["host"], r["domain"]) for r in m.page_rows(page_table(spark, pages)).collect()}
    assert got == {
        1: ("de", "de/fr", "www.site.co.de", "co.de"),
        2: (None, "com", "site.com", "site.com"),
        3: (None, None, "", ""),
        4: (None, None, "", ""),
        5: (None, "host/en", "host", ""),
    }
