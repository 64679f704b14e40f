"""Main text: a plain rule for the tables' template, and other templates by accuracy."""

import html
import itertools
import re

import numpy as np
import pytest

from searchloom.llm import html_text


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), max_pages=80)


def plain(source):
    inside = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = [html.unescape(re.sub(r"<[^>]*>", " ", b)) for b in re.split(r"</?p>|</?h1>", inside)]
    return "\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_whole_table(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r for r in html_text.extract(pages, trees).collect()}
    wrong = [i for i in want if got[i]["text"] != want[i]]
    for i in wrong[:3]:
        print(i, repr(got[i]["text"][:300]), repr(want[i][:300]))
    assert not wrong
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_other_templates(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(60).collect()
    right = total = 0
    for r in pages:
        for seed in (50, 51):
            page = html_text.Page(html_text.rendered(r["html"], seed))
            states = page.states(trees.probability(page.features()))
            for node, text in page.runs:
                total += len(text)
                right += len(text) * ((states[node] == 1) == bool(page.mark[node]))
    print(right / total)
    assert right / total > 0.97


def test_edges(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>unclosed <b>text"), (1, "u", "<div><!-- never closed"), (3, "u", "a < b & c &lt; d"), (4, "u", "<p " * 2000 + '"' * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = html_text.extract(pages, trees).collect()
    assert len(got) == len(rows) and all(r["text"] is not None for r in got)
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0
    with pytest.raises(ValueError):
        html_text.fit(pages)


#: Templates of other makes than those the trees learn from; {0} is the article.
OTHERS = [
    '<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="home"><div id="top"><ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">News of the day</a></li></ul></div>'
    '<div id="wrap"><div class="col-left">{0}</div><div class="col-right sidebar"><h4>Popular</h4><ul><li><a href="/1">One thing</a></li><li><a href="/2">Another</a></li></ul></div></div><div id="footer">Copyright by us, all rights reserved.</div></body></html>',
    '<!doctype html><body><header><h2><a href="/">Site</a></h2><nav><a href="/x">X</a> <a href="/y">Y</a></nav></header><main role="main"><div class="entry-content">{0}</div>'
    '<section class="comments-area"><h3>2 comments</h3><ol><li><p>I like this very much, thank you.</p></li><li><p>Not me.</p></li></ol></section></main><footer><p>About us. Terms. Privacy.</p></footer></body>',
    '<body><table width="100%"><tr><td class="nav"><a href="a">A</a><br><a href="b">B</a></td><td class="text">{0}</td></tr></table><div class="cookie-banner"><p>We use cookies to make this site work, and more.</p><button>Accept</button></div></body>',
    '<body><div class="page"><div class="page__inner"><div class="ads ad-top"><p>Buy one, get one free, only today.</p></div><section class="story-body">{0}<div class="share-tools"><a href="#">Share</a><a href="#">Tweet</a></div></section>'
    '<form class="newsletter"><p>Get our letter every week.</p><input name="mail"><button>Join</button></form></div></div></body>',
]


def test_templates_of_other_makes(spark, trees):
    """Share of characters kept or left out rightly, with articles of the table in hand-made pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(40).collect()
    shares = []
    for template in OTHERS:
        right = total = 0
        for r in pages:
            inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
            page = html_text.Page(template.replace("{0}", inside))
            want = plain(r["html"])
            whole = "\n".join(t for _, t in page.runs)
            got = page.text(page.states(trees.probability(page.features())))
            lines = set(got.split("\n"))
            for line in whole.split("\n"):
                total += len(line)
                right += len(line) * ((line in lines) == (line in want.split("\n")))
        shares.append(right / total)
    print(shares)
    assert min(shares) > 0.9


def test_decoding_is_the_best_of_all(trees):
    """The states against all consistent ones of small trees."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        source = "".join(rng.choice(["<div>", "</div>", "<p>one two", "<section>", "</section>", "text here "], 9))
        page = html_text.Page(source)
        n = len(page.tag)
        p = rng.random(n)
        weight = [0.3 + np.log1p(x) for x in page.own]
        value = lambda s, p=p, w=weight, n=n: sum(w[i] * np.log(p[i] if s[i] == 1 else 1 - p[i]) for i in range(1, n))
        fits = lambda s, page=page: all(s[i] >= s[page.parent[i]] for i in range(1, len(s)))
        if n <= 8:
            best = max(value(s) for x in itertools.product(range(3), repeat=n - 1) if fits(s := (0, *x)))
            got = page.states(p)
            assert fits(got) and abs(value(got) - best) < 1e-9


def test_exported_trees_are_those_of_spark(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label double")
    df = df.select("x", "label", array_to_vector("x").alias("features"))
    model = GBTClassifier(maxIter=6, maxDepth=3, seed=1).fit(df)
    rows = model.transform(df).select("x", vector_to_array("probability").alias("p")).collect()
    got = html_text.exported(model).probability(np.array([r["x"] for r in rows]))
    assert np.allclose(got, [r["p"][1] for r in rows])


def test_unseen_without_an_end(spark, trees):
    page = lambda s: html_text.Page(s).runs
    for tag in ("select", "object", "svg", "noscript", "iframe", "template"):
        assert any("stays here" in t for _, t in page(f"<div><{tag}><p>stays here</p></div>"))
        assert not any("goes" in t for _, t in page(f"<div><{tag}>goes</{tag}><p>stays here</p></div>"))
    assert not any("x" in t for _, t in page("<p>a</p><script>x"))
    long = "<article><p>" + "word " * 300_000 + "</p></article>"
    pages = spark.createDataFrame([(1, None, long), (1, None, long)], "page_id long, url string, html string")
    assert [r["n_chars"] for r in html_text.extract(pages, trees).collect()] == [1_499_999] * 2


def test_unclosed_elements_cost_no_more():
    import time

    from searchloom.llm import html_text as H

    for piece in ("<noscript><p>x</p>", "<svg></div>", "<div></template>", "<!-- <p>", "<p>a</li>", "<object></svg >"):
        page, began = piece * (1_000_000 // len(piece)), time.perf_counter()
        H.Page(page)
        took = time.perf_counter() - began
        print(piece, round(took, 2))
        assert took < 4
    one = "<p>a</p><noscript>b</noscript><SVG x>c</svg ><template>d<p>e<!-- f --><script>g</SCRIPT><iframe>h</iframe><title>i"
    assert H.without_hidden(one) == "<p>a</p><template>d<p>e"
