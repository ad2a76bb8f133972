"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags and classes are one
node of the site's tree. A node's importance is an entropy, in units of the logarithm of its pages:
for presentation, of the sequences of child elements that its pages show below it; for content, of
the texts that stand in it directly. A node whose pages all show the same scores 0; one that
always differs scores 1. A node's score is the larger of the two, drawn to 1 while it has few pages.
Branches with a score under ``LEAST`` leave each page. In the article a block leaves by the score of its
own node only, and the article raises that by ``PRIOR``, so it takes more pages that show the same.

Importance says nothing of a menu or an advert that differs from page to page, so nodes whose tag, role,
class or id names such a part are of no importance either. Where pages have an article or main
element, text outside it is of none. A name counts only if all its parts are such words or say nothing, and is weaker than a tag: an element that holds over
half of the page's text is a wrapper whatever its name, and stays as far as its importance confirms it, unless it
holds comments, or an article stands outside such elements.

Pages are parsed once, in parallel, and written with their blocks compressed, bucketed by page; only
hashes of nodes are shuffled, pre-aggregated by (host, node, shape), so a host with a third of all
pages is spread over its nodes and shapes.
"""

from __future__ import annotations

import html
import json
import re
import zlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, record_batch, shuffle_partitions, table

LEAST = 0.2
#: Pages that a node's score is drawn to 1 with.
FEW_PAGES = 5.0
#: What a block's node has on top of its score in an article or main element.
PRIOR = 0.1

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: Elements that a new one of the same group closes, up to the nearest of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_STOPS = {"button", "table", "td", "th", "caption", "object", "html"}
NOISE_TAGS = RAW | set(
    "head nav aside footer form menu button select option input label fieldset svg canvas video audio object dialog".split()
)
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments disqus "
    "respond replies reply share sharing social related recommended newsletter subscribe signup login popup modal overlay pagination pager widget".split()
)
#: Words that leave a name what the noise words in it make it, as in ad-slot; any other one makes it a name of something else, as in share-price.
GENERIC_WORDS = set(
    "area bar block body bottom box btn button buttons container content entry footer form group header icon icons inner item items left link links list "
    "main module open outer page panel post posts right row section site slot small top unit wrap wrapper global fixed sticky primary secondary".split()
)
COMMENT_WORDS = set("comment comments disqus respond replies reply".split())
#: Classes that tell a page's state, as has-sidebar or no-ads.
STATE = re.compile(r"(?:has|have|with|without|no|not|is)[-_]", re.I)
MAIN_TAGS = {"article", "main"}

MARK = re.compile(r"<(?:(!--)|([!?])|/([a-zA-Z][^\s/>]*)|([a-zA-Z][^\s/>]*))")
#: An attribute of a tag, from where the last one ended; a quote without an end is a letter of a plain value.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?(\s*=\s*)?")
PLAIN = re.compile(r"[^\s>]*")
LOOKED_AT = {"class", "id", "role", "hidden"}
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Raw elements without an end tag: these end at once, the others with the page.
SHORT_RAW = {"title", "textarea", "noscript", "noembed", "noframes"}


class Tags:
    """A page's tags, found in one pass: no part of the page is looked at again, however broken its markup is."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.unclosed: set[str] = set()

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Those of ``LOOKED_AT``, the first of each name, and the place after the tag's end; the page's length if it has none."""
        page, found = self.page, {}
        while at < self.n and page[at] != ">":
            m = ATTRIBUTE.match(page, at)
            name, value = m[1], ""
            start, at = at, m.end()
            if m[2]:
                quote = page[at : at + 1]
                if quote in ("'", '"') and quote and self.last[quote] > at:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = PLAIN.match(page, at)[0]
                    at += len(value)
            if name and name.lower() in LOOKED_AT:
                found.setdefault(name.lower(), html.unescape(value))
            at = max(at, start + 1)
        return found, at + 1 if at < self.n else self.n

    def after_raw(self, tag: str, at: int) -> int:
        """The place after the end tag of a raw element that begins at ``at``."""
        end = None if tag in self.unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if end:
            return end.end()
        self.unclosed.add(tag)
        return at if tag in SHORT_RAW else self.n


class Node:
    #: noise: by tag, role or comments; named: the nearest element at or above this that a keyword names, or 0; inner: whether that lies in an article.
    __slots__ = ("tag", "parent", "path", "noise", "named", "inner", "children", "main")

    def __init__(self, tag: str, parent: int, path: int, noise: bool, named: int, inner: bool, main: bool):
        self.tag, self.parent, self.path, self.noise, self.named, self.inner, self.main, self.children = tag, parent, path, noise, named, inner, main, []


def _node(nodes: list[Node], above: int, tag: str, found: dict[str, str]) -> Node:
    parent = nodes[above]
    names = [c for k in ("class", "id") for c in found.get(k, "").split() if not STATE.match(c)]
    parts = [{w for w in SPLIT.split(x.lower()) if w} for c in names for x in {c, CAMEL.sub("-", c)}]
    words = {w for p in parts if p & NOISE_WORDS and p <= NOISE_WORDS | GENERIC_WORDS for w in p}
    main = tag in MAIN_TAGS or found.get("role", "").lower() == "main"
    within = parent.main
    hidden = found.get("hidden", "until-found").lower() not in ("until-found", "false")
    noise = tag in NOISE_TAGS or found.get("role", "").lower() in NOISE_ROLES or hidden
    noise = noise or tag == "header" and not within or parent.noise
    keyword = bool(words & NOISE_WORDS) and tag not in ("html", "body") and not main
    noise = noise or keyword and bool(words & COMMENT_WORDS)
    named, inner = (len(nodes), within) if keyword else (parent.named, parent.inner)
    # The path is a hash of the parent's and this one's tag and classes, so deep markup has no long paths.
    path = _hash(f"{parent.path}/{tag}.{'.'.join(sorted(found.get('class', '').lower().split()))}")
    # A main element inside a noisy one, as in a comment's article, is not the page's.
    return Node(tag, above, path, noise, named, inner, (main or within) and not noise)


class Open:
    """The open elements, and where those of a tag, or of a group of tags, lie among them."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack = nodes, [0]
        self.of_tag: dict[str, list[int]] = {}

    def push(self, number: int) -> None:
        self.of_tag.setdefault(self.nodes[number].tag, []).append(len(self.stack))
        self.stack.append(number)

    def nearest(self, tags: set[str]) -> int:
        """The place of the innermost open element of these tags; 0 if none is open."""
        return max((self.of_tag[t][-1] for t in tags if self.of_tag.get(t)), default=0)

    def close(self, k: int) -> bool:
        """Closes the elements from place k on; tells whether one makes a block."""
        block = False
        while len(self.stack) > k:
            tag = self.nodes[self.stack.pop()].tag
            self.of_tag[tag].pop()
            block = block or tag in BLOCK
        return block


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Elements in page order, and blocks of text: the number of the element and the text, in page order.

    An unclosed element ends with its parent; a stray end tag is ignored, and a tag that the page's end cuts off is no text. Text between
    blocks of the same element makes blocks of its own. Takes time in proportion to the page, however deep or broken it is.
    """
    page = page or ""
    nodes = [Node("", 0, 0, False, 0, True, False)]
    tags, open_ = Tags(page), Open(nodes)
    blocks: list[tuple[int, list[str]]] = []
    open_block, kind = False, None

    def text(piece: str) -> None:
        nonlocal open_block, kind
        # A block belongs to its nearest block element; inline elements are part of it, noisy ones apart.
        at = open_.stack[-1]
        here = (nodes[at].noise, nodes[at].named, nodes[at].main)
        if not open_block or kind != here:
            blocks.append((at, []))
            open_block, kind = True, here
        blocks[-1][1].append(piece)

    def close(k: int) -> None:
        nonlocal open_block
        if open_.close(k):
            open_block = False

    at, from_ = 0, 0
    while at < tags.n:
        m = MARK.search(page, at)
        if not m:
            break
        if m.start() > from_:
            text(page[from_ : m.start()])
        if m[1] is None and tags.last[">"] < m.end():
            from_ = tags.n
            break
        if m[1]:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else tags.n
        elif m[2] or m[3]:
            at = page.index(">", m.end()) + 1
            if m[3]:
                tag = m[3].lower()
                if open_.of_tag.get(tag):
                    close(open_.of_tag[tag][-1])
                elif tag in ("br", "p"):
                    open_block = False
        else:
            tag = m[4].lower()
            found, at = tags.attributes(m.end())
            if at == tags.n and page[-1] != ">":
                from_ = at
                break
            if tag in BLOCK:
                open_block = False
                if tag != "br":
                    k = open_.nearest({"p"} | P_STOPS)
                    if k and nodes[open_.stack[k]].tag == "p":
                        close(k)
            if tag in CLOSES:
                same, stops = CLOSES[tag]
                stop = open_.nearest(stops)
                lowest = min((k for t in same if (k := next((k for k in open_.of_tag.get(t, ())[::-1] if k > stop), 0))), default=0)
                if lowest:
                    close(lowest)
            number, above = len(nodes), open_.stack[-1]
            nodes.append(_node(nodes, above, tag, found))
            nodes[above].children.append(tag)
            if tag in RAW:
                at = tags.after_raw(tag, at)
            elif tag not in VOID and not (tag in ("svg", "path") and page[at - 2] == "/"):
                open_.push(number)
        from_ = at
    if from_ < tags.n:
        text(page[from_:])
    return nodes, [(i, t) for i, parts in blocks if (t := " ".join(html.unescape("".join(parts)).split()))]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def noisy(nodes: list[Node], blocks: list[tuple[int, str]]) -> list[bool]:
    """Of each block whether it lies in noise, by tags or by names of elements that are no wrappers of the page's text."""
    named = [k for k in range(1, len(nodes)) if nodes[k].named == k]
    up = {k: nodes[nodes[k].parent].named for k in named}
    all_inner = {0: True}
    for k in named:
        all_inner[k] = nodes[k].inner and all_inner[up[k]]
    held, total, clear = dict.fromkeys([0, *named], 0), 0, False
    for i, text in blocks:
        if not nodes[i].noise:
            total += len(text)
            clear = clear or nodes[i].main and all_inner[nodes[i].named]
            held[nodes[i].named] += len(text)
    for k in reversed(named):
        held[up[k]] += held[k]
    bad = {0: False}
    for k in named:
        bad[k] = bad[up[k]] or 2 * held[k] <= total or clear and not nodes[k].inner
    return [nodes[i].noise or bad[nodes[i].named] for i, _ in blocks]


def describe(page: str | None) -> tuple[list[int], list[int], list[int], tuple[list[int], list]]:
    """Of a page's distinct nodes the hash of path, shape and content; the number of each one's parent, and the blocks as (text, node, noise, main).

    A node's content are the texts at and below it, whatever their order.
    """
    nodes, blocks = parse(page)
    numbers: dict[int, int] = {}
    shapes: list[list[str]] = []
    parents: list[int] = []
    for node in nodes[1:]:
        k = numbers.setdefault(node.path, len(numbers))
        if k == len(shapes):
            shapes.append([])
            parents.append(numbers[nodes[node.parent].path] if node.parent else -1)
        shapes[k] += [c for j, c in enumerate(node.children) if not j or node.children[j - 1] != c]
    contents = [0] * len(shapes)
    out = []
    for (i, text), noise in zip(blocks, noisy(nodes, blocks)):
        k = numbers[nodes[i].path] if i else -1
        if k >= 0:
            contents[k] += _hash(text)
        out.append((text, k, noise, nodes[i].main and not noise))
    for k in range(len(contents) - 1, -1, -1):
        if parents[k] >= 0:
            contents[parents[k]] += contents[k]
    return list(numbers), [_hash(" ".join(s)) for s in shapes], [_hash(str(c)) for c in contents], (parents, out)


PARSED = "page long, page_id long, url string, host string, node array<long>, shape array<long>, content array<long>, blocks binary"


def parsed(pages: DataFrame) -> DataFrame:
    arrow = pa.list_(pa.int64())

    def run(batches):
        part, serial = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                found = [describe(p) for p in b["html"].to_pylist()]
                columns = {
                    "page": pa.array([(part << 32) | (serial + k) for k in range(len(found))], pa.int64()),
                    "page_id": b["page_id"].cast(pa.int64()),
                    "url": b["url"],
                    "host": b["host"],
                    **{n: pa.array([f[k] for f in found], arrow) for k, n in enumerate(("node", "shape", "content"))},
                    "blocks": pa.array([zlib.compress(json.dumps(f[3]).encode(), 1) for f in found], pa.binary()),
                }
                serial += len(found)
                yield pa.record_batch(list(columns.values()), names=list(columns))

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    return pages.select("page_id", F.col("url").cast("string"), host.alias("host"), "html").mapInArrow(run, PARSED)


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, score) of the site trees."""
    zipped = F.explode(F.arrays_zip("node", F.array_repeat(F.lit(0), F.size("node")).alias("x"), "shape", "content"))
    rows = pages.select("host", zipped.alias("z")).select("host", "z.node", F.expr("stack(2, 'shape', z.shape, 'content', z.content) AS (kind, form)"))
    forms = rows.groupBy("host", "node", "kind", "form").agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    entropy = (F.log(total) - F.sum(F.col("n") * F.log("n")) / total) / F.log(total)
    kinds = forms.groupBy("host", "node", "kind").agg(total.alias("pages"), F.when(total > 1, entropy).otherwise(1.0).alias("entropy"))
    scores = kinds.groupBy("host", "node").agg(F.max("entropy").alias("entropy"), F.max("pages").alias("pages"))
    drawn = (F.col("entropy") * F.col("pages") + FEW_PAGES) / (F.col("pages") + FEW_PAGES)
    return scores.select("host", "node", drawn.alias("score"))


def main_text(page: tuple[list[int], list], scores: list[float]) -> str:
    """The page's text: its main element's blocks if it has one, less noise and less branches of low importance."""
    parents, blocks = page
    low: list[bool] = []
    for parent, score in zip(parents, scores):
        low.append(score < LEAST or parent >= 0 and low[parent])
    has_main = any(main for _, _, _, main in blocks)
    kept = []
    for text, k, noise, main in blocks:
        if noise or has_main and not main:
            continue
        if k >= 0 and (scores[k] + PRIOR < LEAST if main else low[k]):
            continue
        kept.append(text)
    return " ".join(kept)


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page.

    Takes (page_id long, url string, html string); other columns are ignored. Returns page_id, url, text
    and n_chars, a row for each input row, also where page_ids repeat; repeated pages count as pages of
    their host. Null html is empty and has an empty text; pages without a url belong to one host
    without a name. Long pages are parsed whole. An empty table gives no rows.
    """
    spark = pages.sparkSession
    space = Workspace(spark, "sites")
    stored = space.save_bucketed(parsed(pages), "pages", "page", max(8, shuffle_partitions(spark)))
    nodes = stored.select("page", "host", F.posexplode("node").alias("at", "node"))
    scores = nodes.join(importance(stored), ["host", "node"]).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("scores"))

    def run(batches):
        for b in batches:
            texts = []
            for blocks, scored in zip(b["blocks"].to_pylist(), b["scores"].to_pylist()):
                texts.append(main_text(json.loads(zlib.decompress(blocks)), [s["score"] for s in scored or []]))
            yield record_batch({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": list(map(len, texts))}, RESULT)

    return stored.join(scores, "page", "left").select("page_id", "url", "blocks", "scores").mapInArrow(run, RESULT)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
