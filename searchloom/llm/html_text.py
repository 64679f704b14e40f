"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements. Each has features of its tag, its depth, the text, link
and tag density of its subtree, the tokens of its class and id, its siblings and its ancestors.
Gradient-boosted trees (``pyspark.ml``) give the probability that a node belongs to the article.
Decoding picks the most probable consistent states from the root down: outside, article, or
boilerplate, where boilerplate holds all below it and only boilerplate may follow inside the
article; so no node is kept under an ancestor that was thrown out.

The trees are fitted on at most ``max_pages`` pages that name their article with a tag, those with
the smallest hash of their id. Each is also rendered in other ways, with other tags, class names
and extra menus, notices, forms and comments made of its own words, so that the trees learn more
than one template. The fitted trees are a few numbers; pages are read whole, where they lie.

Edge cases. A null html is empty and gives an empty text. Unclosed and misplaced tags are mended
as browsers mend the common cases: a script, style, text area, title or comment without an end runs
to the end of the page, other unseen elements without an end lose their tag alone. Ids and urls may
be null or repeated; every row has its own result. Without a page to learn from ``fit`` is an error:
fit on other pages and give ``extract`` the trees. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, small_batches

#: Pages in a fit at most, renderings of each, trees, their depth.
MAX_PAGES, RENDERINGS, TREES, DEPTH = 200, 4, 12, 4

#: What hides text: comments, elements that run to the end of the page if it must be, others.
HIDING = re.compile(r"<!--|<(?:(script|style|textarea|title)|(noscript|template|svg|iframe|object|select))\b", re.I)
HIDDEN_END = re.compile(r"</(noscript|template|svg|iframe|object|select)\s*>", re.I)
RAW_END = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title")}
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""")
NAMED = re.compile(r"""(?:class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
MARK = re.compile(r'data-y="([01])"')
TOKEN = re.compile(r"[a-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark q ruby rp rt s "
    "samp small span strike strong sub sup time tt u var wbr button picture source track area base link meta param col".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
}
PARAGRAPH = frozenset(["p"])

TAGS = "html body main article section div p h1 h2 h3 h4 ul ol li table tr td blockquote pre nav header footer aside form figure head dl".split()
GOOD = frozenset("article content main post entry story text prose body page reading news blog".split())
BAD = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav menu navbar navigation breadcrumb breadcrumbs header masthead "
    "footer foot sidebar side aside rail widget related recommended share social comment comments discussion replies reply "
    "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login form search pagination pager "
    "toolbar copyright legal disclaimer tags meta byline".split()
)
#: Buckets of hashed class, id and role tokens, beside the counts of the known ones above.
TOKENS = 32
N_FEATURES = len(TAGS) + 24 + TOKENS


def without_hidden(source: str) -> str:
    """The page without comments and elements that show no text. Where such elements end is found once for
    the page, so many of them without an end cost no more than others."""
    ends: dict[str, list[tuple[int, int]]] | None = None
    out, at, found = [], 0, HIDING.search(source)
    while found:
        if found[0] == "<!--":
            end = source.find("-->", found.end()) + 3
            end = end if end >= 3 else len(source)
        elif found[1]:
            shut = RAW_END[found[1].lower()].search(source, found.end())
            end = shut.end() if shut else len(source)
        else:
            if ends is None:
                ends = {}
                for m in HIDDEN_END.finditer(source):
                    ends.setdefault(m[1].lower(), []).append(m.span())
            spans = ends.get(found[2].lower(), [])
            n = bisect_left(spans, (found.end(), 0))
            if n == len(spans):
                found = HIDING.search(source, found.end())
                continue
            end = spans[n][1]
        out.append(source[at : found.start()])
        at = end
        found = HIDING.search(source, end)
    return "".join([*out, source[at:]])


class Page:
    """Block nodes of a page in document order, and runs of text, each in one node."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.depth, self.names, self.mark = [-1], [-1], [0], [""], [0]
        self.own, self.link, self.stops, self.words, self.inputs, self.links = [0], [0], [0], [0], [0], [0]
        self.place, self.kids = [0], [0]
        self.runs: list[tuple[int, str]] = []
        self._parse(without_hidden(source or ""))

    def _node(self, name: str, attributes: str, parent: int, place: int) -> int:
        self.tag.append(name)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        named, mark = "", self.mark[parent]
        if attributes:
            named = " ".join(NAMED.findall(attributes)).lower()
            if "data-y" in attributes and (m := MARK.search(attributes)):
                mark = int(m[1])
        self.names.append(named)
        self.mark.append(mark)
        for x in (self.own, self.link, self.stops, self.words, self.inputs, self.links, self.kids):
            x.append(0)
        self.kids[parent] += 1
        self.place.append(place)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack, at, place = [0], 0, 0
        open_ = Counter()
        held: list[str] = []
        in_link = False

        def flush() -> None:
            nonlocal place
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                held.clear()
                if text:
                    self.runs.append((stack[-1], text))
                    place += len(text)

        def add(piece: str) -> None:
            held.append(piece)
            node = stack[-1]
            size = len(piece.strip())
            self.own[node] += size
            if in_link:
                self.link[node] += size
            else:
                self.stops[node] += piece.count(".") + piece.count(",")
            self.words[node] += piece.count(" ")

        for m in TAG.finditer(source):
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if name in INLINE:
                if name == "a":
                    in_link = not m[1]
                    self.links[stack[-1]] += in_link
                elif name in ("input", "button", "label"):
                    self.inputs[stack[-1]] += not m[1]
                if name == "br" or name == "img":
                    held.append(" ")
                continue
            flush()
            if m[1]:
                while open_[name]:  # with all that was opened within
                    last = self.tag[stack.pop()]
                    open_[last] -= 1
                    if last == name:
                        break
                continue
            shut = CLOSED_BY.get(name, PARAGRAPH)
            while len(stack) > 1 and self.tag[stack[-1]] in shut:
                open_[self.tag[stack.pop()]] -= 1
            node = self._node(name, m[3], stack[-1], place)
            if name not in VOID and not m[3].endswith("/"):
                stack.append(node)
                open_[name] += 1
        if at < len(source):
            add(source[at:])
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        total = {k: list(getattr(self, k)) for k in ("own", "link", "stops", "words", "inputs", "links")}
        own, link, stops, words, inputs, links = total.values()
        nodes, para, heads, items = [1] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            t = self.tag[i]
            if t == "p":
                para[i] += 1
            elif t in ("h1", "h2", "h3"):
                heads[i] += 1
            elif t == "li":
                items[i] += 1
            for x in (own, link, stops, words, inputs, links, nodes, para, heads, items):
                x[p] += x[i]
        out = np.zeros((n, N_FEATURES))
        good, bad = [0] * n, [0] * n
        seen = [0] * n
        length = max(1, own[0])
        beside, beside_link = [0] * n, [0] * n
        for i in range(1, n):
            beside[self.parent[i]] += own[i]
            beside_link[self.parent[i]] += link[i]
        k = len(TAGS)
        for i in range(1, n):
            p, row = self.parent[i], out[i]
            if (t := _TAG_AT.get(self.tag[i])) is not None:
                row[t] = 1
            mine = TOKEN.findall(self.names[i]) if self.names[i] else ()
            hit_good = sum(x in GOOD for x in mine)
            hit_bad = sum(x in BAD for x in mine)
            good[i], bad[i] = good[p] + hit_good, bad[p] + hit_bad
            size, others = own[i], max(1, self.kids[p] - 1)
            for x in mine:
                row[k + 24 + zlib.crc32(x.encode()) % TOKENS] = 1
            row[k : k + 24] = (
                self.depth[i], math.log1p(size), link[i] / max(1, size), math.log1p(self.own[i]), stops[i] / max(1, size),
                size / max(1, words[i]), nodes[i] / max(1, size), math.log1p(para[i]), math.log1p(items[i]), heads[i] > 0,
                math.log1p(links[i]), min(inputs[i], 5), hit_good, hit_bad, good[p], bad[p], size / length, self.place[i] / length,
                seen[p] / max(1, self.kids[p]), self.kids[p], math.log1p((beside[p] - size) / others),
                (beside_link[p] - link[i]) / max(1, beside[p] - size), _KIN.get(self.tag[p], 0), math.log1p(self.kids[i]),
            )
            seen[p] += 1
        return out

    def states(self, probability: np.ndarray) -> list[int]:
        """0 outside, 1 article, 2 boilerplate, for each node: the most probable that fit."""
        n = len(self.tag)
        yes = np.log(np.clip(probability, 1e-4, 1 - 1e-4))
        no = np.log1p(-np.clip(probability, 1e-4, 1 - 1e-4))
        best = np.zeros((n, 3))
        # nodes without text of their own say less
        weight = [0.3 + math.log1p(x) for x in self.own]
        for i in range(n - 1, -1, -1):
            best[i] += (no[i] * weight[i], yes[i] * weight[i], no[i] * weight[i])
            if i:
                a, b, c = best[i]
                best[self.parent[i]] += (max(a, b, c), max(b, c), c)
        state = [0] * n
        for i in range(1, n):
            above = state[self.parent[i]]
            state[i] = above + int(np.argmax(best[i][above:]))
        return state

    def text(self, states: list[int]) -> str:
        return "\n".join(t for node, t in self.runs if states[node] == 1)


_TAG_AT = {t: n for n, t in enumerate(TAGS)}
_KIN = {"article": 3, "main": 2, "section": 1, "nav": -2, "header": -2, "footer": -2, "aside": -2, "form": -2}


class Trees:
    """Fitted boosted trees as arrays; ``probability`` of rows of features."""

    def __init__(self, trees: list[tuple[float, list[tuple[int, float, int, int, float]]]]):
        self.trees = [(w, *(np.array(c) for c in zip(*nodes, strict=True))) for w, nodes in trees]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def exported(model) -> Trees:
    """The trees of a fitted ``GBTClassificationModel``."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list = []

        def walk(node, nodes: list = nodes) -> int:
            at = len(nodes)
            nodes.append(None)
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                left, right = walk(node.leftChild()), walk(node.rightChild())
                nodes[at] = (split.featureIndex(), split.threshold(), left, right, 0.0)
            else:
                nodes[at] = (-1, 0.0, 0, 0, node.prediction())
            return at

        walk(tree._call_java("rootNode"))
        out.append((weight, nodes))
    return Trees(out)


ARTICLE = re.compile(r"<article\b([^>]*)>(.*)</article\s*>", re.S | re.I)
BLOCKS = re.compile(r"<(nav|footer|header|aside|form)\b[^>]*>(.*?)</\1\s*>|<div class=\"ad\">(.*?)</div>", re.S | re.I)


def rendered(source: str, seed: int) -> str | None:
    """A page with its article and boilerplate marked; another template for each seed above 0."""
    m = ARTICLE.search(source)
    if not m:
        return None
    before, inside, after = source[: m.start()], m[2], source[m.end() :]
    if not seed:
        return f'{before}<article{m[1]} data-y="1">{inside}</article>{after}'
    rng = random.Random(zlib.crc32(source.encode()) * 31 + seed)
    words = re.sub(r"<[^>]*>", " ", without_hidden(source)).split() or ["word"]
    say = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    name = lambda *x: rng.choice(x)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{say(1, 4)}</a></li>' for i in range(n))

    def other(k: re.Match) -> str:
        body = k[2] if k[2] is not None else k[3]
        kind = (k[1] or "ad").lower()
        classes = {
            "nav": ("menu", "navbar", "navigation", "top-nav"), "footer": ("footer", "site-footer", "foot"), "header": ("header", "masthead"),
            "aside": ("sidebar", "side", "rail"), "form": ("form", "signup"), "ad": ("ad", "ads", "advert", "sponsored", "promo", "banner"),
        }[kind]
        return f'<div {name("class", "id")}="{name(*classes)}">{body}</div>'

    def extra() -> str:
        kind = rng.randrange(8)
        if kind == 0:
            return f'<{name("aside", "div")} class="{name("sidebar", "widget", "related", "rail")}"><h3>{say(1, 4)}</h3><ul>{links(rng.randint(2, 8))}</ul><p>{say(5, 40)}</p></{name("aside", "div")}>'
        if kind == 1:
            return f'<div class="{name("cookie-notice", "cookie consent", "notice", "alert", "banner", "popup")}"><p>{say(6, 40)}.</p><button>{say(1, 2)}</button></div>'
        if kind == 2:
            one = lambda: f'<div class="{name("comment", "reply", "comment-body")}"><b>{say(1, 2)}</b><p>{say(5, 60)}.</p></div>'
            return f'<{(t := name("section", "div"))} {name("class", "id")}="{name("comments", "discussion", "replies", "comment-list")}"><h2>{say(1, 3)}</h2>{"".join(one() for _ in range(rng.randint(1, 5)))}</{t}>'
        if kind == 3:
            return f'<form action="/s" class="{name("search", "newsletter", "subscribe", "login")}"><label>{say(1, 4)}</label><input name="q"><p>{say(3, 25)}</p><button>{say(1, 2)}</button></form>'
        if kind == 4:
            return f'<header class="{name("site-header", "masthead", "top")}"><h2><a href="/">{say(1, 3)}</a></h2><p>{say(3, 12)}</p></header>'
        if kind == 5:
            return f'<div class="{name("ad", "advert", "advertisement", "sponsored", "promo")}"><p>{say(5, 40)}.</p></div>'
        if kind == 6:
            return f'<div class="{name("share", "social", "breadcrumb", "breadcrumbs", "pagination", "toolbar")}"><ul>{links(rng.randint(2, 6))}</ul></div>'
        return f'<aside><h3>{say(1, 4)}</h3><p>{say(10, 60)}.</p></aside>'

    def marked(block: str) -> str:
        return re.sub(r"<(\w+)", r'<\1 data-y="0"', block, count=1)

    parts = re.split(r"(?=<p>|<p )", inside)
    for _ in range(rng.randint(0, 2)):
        at = rng.randint(1, len(parts))
        if at == len(parts):
            parts.append(marked(extra()))
        else:
            parts[at] = marked(extra()) + parts[at]
    inside = "".join(parts)
    before, after = BLOCKS.sub(other, before), BLOCKS.sub(other, after)
    before += "".join(extra() for _ in range(rng.randint(0, 3)))
    after = "".join(extra() for _ in range(rng.randint(0, 3))) + after
    tag = name("article", "main", "div", "section", "div")
    named = name("", ' class="content"', ' class="post-content"', ' id="main"', ' class="entry"', ' class="article-body"', ' class="story"') if tag in ("div", "section") else ""
    body = f'<{tag}{named} data-y="1">{inside}</{tag}>'
    if rng.random() < 0.5:
        body = f'<div class="{name("container", "wrapper", "layout", "page")}">{body}{extra() if rng.random() < 0.5 else ""}</div>'
    return before + body + after


def fit(pages: DataFrame, max_pages: int = MAX_PAGES, renderings: int = RENDERINGS) -> Trees:
    """Trees fitted on ``pages`` (``page_id, html``), which must have some that name their article."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    chosen = (
        pages.select("page_id", "html")
        .filter(F.col("html").rlike("(?is)<article\\b.*</article"))
        .select(F.xxhash64("page_id", "html").alias("h"), "html")
        .orderBy("h", "html")
        .limit(max_pages)
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = [], []
            for source in batch["html"]:
                for seed in range(renderings + 1):
                    page = Page(rendered(source, seed))
                    x += list(page.features()[1:])
                    y += page.mark[1:]
            yield pd.DataFrame({"x": x, "label": np.array(y, float)})

    labelled = materialize(chosen.mapInPandas(rows, "x array<double>, label double"), "nodes")
    if labelled.select("label").distinct().count() < 2:
        if pages.isEmpty():
            return Trees([])
        raise ValueError("no page names its article with a tag: give labelled pages, or trees fitted on others")
    frame = labelled.coalesce(4).select(array_to_vector("x").alias("features"), "label")
    return exported(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(frame))


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for at in range(0, len(batch), 100):
                parsed = [Page(s) for s in batch["html"].iloc[at : at + 100]]
                found = [p.features() for p in parsed]
                probability = shared.value.probability(np.concatenate(found))
                ends = np.cumsum([len(x) for x in found])
                for page, p in zip(parsed, np.split(probability, ends[:-1]), strict=True):
                    texts.append(page.text(page.states(p)))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(rows, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = read(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
