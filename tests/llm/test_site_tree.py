import math
import random
import time
from collections import Counter

import pytest

from trackloom.llm import site_tree as m

from .conftest import documents  # noqa: F401

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>x="</p>"</script></head><body>
<header>Site</header><nav><ul><li><a href="/">{nav}</a></ul></nav><!-- ad --><div class="ad">{ad}</div>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article><header><h1>{title} &amp; more</h1></header><p><b>{one}<br><p>two
 lines&nbsp;here<p>t<b>hr</b>ee<ul><li>i<li>j</ul><form>Name <input></form>
<div id="comments"><article>Nice</article></div><p>end</article><footer>&copy; x</footer></body></html>"""


def table(spark, pages):
    return spark.createDataFrame([(*p, "x", 3) for p in pages], "page_id long, url string, html string, host string, node int")


def text(df):
    return sorted((tuple(r) for r in m.extract(df).collect()), key=str)


def test_article_pages(spark):
    pages = [(i, f"http://h{i % 2}.com/{i}", PAGE.format(nav=f"n{i}", ad=f"buy {i}", title=f"T{i}", one=f"one {i}")) for i in range(12)]
    pages += [(50, None, None), (51, "http://h0.com", ""), (52, "x", "no markup &lt; here"), (None, "http://h0.com", "<p>a<p>b"), pages[0], (1, "http://h1.com", "<main>other</main>")]
    want = [(i, u, f"T{i} & more one {i} two lines here three i j end") for i, u, _ in pages[:12]]
    want += [(50, None, ""), (51, "http://h0.com", ""), (52, "x", "no markup < here"), (None, "http://h0.com", "a b"), want[0], (1, "http://h1.com", "other")]
    assert text(table(spark, pages)) == sorted(((*w, len(w[2])) for w in want), key=str)


def test_repeated_branches_leave_pages_without_an_article(spark):
    rnd = random.Random(1)
    pages = []
    for i in range(60):
        body = f"<div class=top>Same for all</div><div class=body><p>{rnd.random()}</p><p>{rnd.random()}</p></div><div class=end>All rights</div>"
        pages.append((i, "http://one.org/", f"<html><body>{body}</body></html>"))
    got = text(table(spark, pages))
    assert all("Same" not in r[2] and "rights" not in r[2] and len(r[2].split()) == 2 for r in got)
    # One page says nothing of its site: nothing is repeated.
    assert "Same for all" in text(table(spark, pages[:1]))[0][2]


def test_importance_is_the_entropy(spark):
    rnd = random.Random(2)
    pages = [(i, f"http://h{i % 2}.org/", f"<div class={rnd.choice('ab')}>{rnd.choice(['x', 'y', 'z'])}<i>q</i></div>" * rnd.randrange(3)) for i in range(40)]
    found = m.parsed(m_pages := table(spark, pages)).cache()
    got = {(r["host"], r["node"]): r["score"] for r in m.importance(found).collect()}
    want: dict = {}
    for _, url, page in pages:
        node, shape, content, _ = m.describe(page)
        for n, s, c in zip(node, shape, content):
            of = want.setdefault((url[7:-1], n), (Counter(), Counter()))
            of[0][s] += 1
            of[1][c] += 1
    entropy = lambda c: -sum(n / sum(c.values()) * math.log(n / sum(c.values()), sum(c.values())) for n in c.values())
    for key, (s, c) in want.items():
        n = sum(s.values())
        h = max(entropy(s), entropy(c)) if n > 1 else 1.0
        assert got[key] == pytest.approx((h * n + m.FEW_PAGES) / (n + m.FEW_PAGES))
    assert set(got) == set(want) and m_pages.count() == 40


def test_odd_markup():
    for page, want in [
        ("<p>a</b></p>b<script>x", "a b"),
        ("<div>x<!-- never closed", "x"),
        ("a < b &noentity; <p class='ad x'>no</p>", "a < b &noentity;"),
        ('<div title="a > b">t</div>', "t"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<p>" * 300 + "deep", "deep"),
        ("<span>a</span><span>b</span>c", "abc"),
        ("<div class=sidebarx>kept</div><div class=leftSidebar>gone</div>", "kept"),
        ("<p>whole</p><title>never closed<p>rest", "whole never closed rest"),
        ("<p>text<a href='cut off", "text"),
        ("<p class='a' class=ad>first counts</p><p id = ad>gone", "first counts"),
        ("<p hidden>no</p><p hidden=until-found>yes</p>", "yes"),
    ]:
        *_, blocks = m.describe(page)
        assert m.main_text(blocks, [1.0] * 400) == want, page


def test_empty(spark):
    assert m.extract(table(spark, [])).collect() == []


def test_repeated_branches_leave_articles(spark):
    rnd = random.Random(3)
    own = [f"{rnd.random()} {rnd.random()}" for _ in range(60)]
    body = "<article><h1>{0}</h1><p>{1}</p><p>Same words, in a node of text that differs</p><div class=box><p>Licence line</p></div><div>Letters <b>by mail</b></div></article>"
    pages = [(i, f"http://one.org/{i}", body.format(i, x)) for i, x in enumerate(own)]
    assert [r[2] for r in sorted(text(table(spark, pages)), key=lambda r: r[0])] == [f"{i} {x} Same words, in a node of text that differs" for i, x in enumerate(own)]
    # Few pages leave the article whole.
    assert all(r[2].endswith("Licence line Letters by mail") for r in text(table(spark, pages[:20])))


def test_classes_with_slashes():
    for page in ["<html><body><div class=w-1/2><p>a<b class='md:w-2/3 basis-1/3'>b</b></p></div></body></html>", "<div class=/>ab</div>", "<div class='x/p.'><p>ab"]:
        node, _, _, blocks = m.describe(page)
        assert m.main_text(blocks, [1.0] * 9) == "ab" and max(blocks[0]) < len(node) == len(set(node))


def test_wrappers_named_like_noise_keep_the_article():
    article = "<article><p>The long text of the page</p><div class=share>Send it</div><div class=comments><article>Nice</article></div></article>"
    for name in ["page has-sidebar", "with-sidebar", "no-ads", "menu-open", "widget", "related-layout", "cookie-consent-given", "pageSidebar"]:
        for page in [f"<body><nav>Menu</nav><div class='{name}'>{article}<aside>Side</aside></div><div class=ad>Buy</div>", f"<div class='{name}'><p>The long text of the page</p></div><div class=ad>Buy</div>"]:
            *_, blocks = m.describe(page)
            assert m.main_text(blocks, [1.0] * 40) == "The long text of the page", (name, page)
    # A list of other articles is no wrapper, however long; a wrapper that is the same on all pages goes.
    *_, blocks = m.describe("<article>Own text</article><div class=related><article>Another article that is longer</article></div>")
    assert m.main_text(blocks, [1.0] * 40) == "Own text"
    *_, blocks = m.describe("<div class=widget><p>Same everywhere</p></div>")
    assert m.main_text(blocks, [0.05] * 40) == ""


def test_attributes_that_only_look_like_noise():
    for start in ['<div style="overflow:hidden">', '<p aria-hidden="false">', '<p title="a hidden gem">', '<p data-id="share-7">', '<p class="share-price">', '<p class="comments-on-law">', "<p title=\"class='ad'\">"]:
        *_, blocks = m.describe(f"<article><p>Before the part</p>{start}The part itself</p></div></article>")
        assert m.main_text(blocks, [1.0] * 9) == "Before the part The part itself", start


def test_broken_and_deep_pages_take_time_in_proportion():
    n = 100_000
    began = time.monotonic()
    for page in ["<a " * n * 3, "<div>" * n, "<div>x" * n, "<p><button>" + "<div>" * n, "<div>" * n + "</span>" * n, "<div>" * n + "<li>" * n, '<a b="' * n + ">", "<a '" * n + "'>'",
                 "<title>" * n, "<!--" * n, "<" * n, "<div class=ad>x" * n, "</" * n + ">", "<ul>" + "<li><div>" * n]:
        m.main_text(m.describe(page)[-1], [1.0] * 4 * n)
    assert time.monotonic() - began < 60


def test_whole_texts_equal_a_plain_site_tree(spark):
    """The operator against nested loops over pages, ancestors and forms."""
    rnd = random.Random(8)
    pages = []
    for i in range(90):
        parts = [f"<div class=s{rnd.randrange(3)}><p>own {rnd.random()}</p></div>" for _ in range(rnd.randrange(1, 4))]
        parts.insert(rnd.randrange(len(parts) + 1), "<div class=box><p>Same note</p><i>again</i></div>")
        body = "".join(parts)
        pages.append((i, f"http://h{i % 3 // 2}.org/", f"<body><article>{body}</article></body>" if i % 2 else f"<body>{body}<div class=menu-like>{rnd.choice('ab')}</div></body>"))
    trees = [m.parse(p) for _, _, p in pages]

    def path(nodes, i):
        return [] if not i else [*path(nodes, nodes[i].parent), nodes[i].path]

    forms: dict = {}
    for (_, url, _), (nodes, blocks) in zip(pages, trees):
        for key in {n.path for n in nodes[1:]}:
            shape = [c for n in nodes[1:] if n.path == key for j, c in enumerate(n.children) if not j or n.children[j - 1] != c]
            content = sorted(t for i, t in blocks if key in path(nodes, i))
            for kind, form in (("shape", shape), ("content", content)):
                forms.setdefault((url, key), {}).setdefault(kind, []).append(str(form))

    def score(url, key):
        h, n = 0.0, 0
        for kind in ("shape", "content"):
            c = Counter(forms[url, key][kind])
            n = sum(c.values())
            h = max(h, -sum(x / n * math.log(x / n, n) for x in c.values()) if n > 1 else 1.0)
        return (h * n + m.FEW_PAGES) / (n + m.FEW_PAGES)

    want = []
    for (i, url, _), (nodes, blocks) in zip(pages, trees):
        kept = []
        for k, t in blocks:
            scores = [score(url, key) for key in path(nodes, k)]
            if scores[-1] + m.PRIOR >= m.LEAST if nodes[k].main else min(scores) >= m.LEAST:
                kept.append(t)
        want.append((i, url, " ".join(kept), len(" ".join(kept))))
    assert text(table(spark, pages)) == sorted(want, key=str)
    assert any("Same note" not in w[2] and w[2] for w in want)
