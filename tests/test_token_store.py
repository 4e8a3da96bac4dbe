"""Readers of the stored token table against the per-page operators, and its intervals against a stack."""

import random
import re

import pytest

from pagewright.operators import pages as P
from pagewright.operators.token_store import VOID_TAGS, TokenStore

BITS = [
    "<p>", "</p>", "<div class=x>", "</div>", "<DIV>", "</Div >", "<nav>", "</nav>", "<aside/>", "</aside>", "<footer id='f'>", "</footer>", "<svg>", "</svg>", "<br>", "<br/>", "</br>", "<img src=a>",
    "text ", "&amp; &lt;b&gt; ", "\n\t", "<", "a < b ", "<!-- c <p> -->", "<!doctype html>", "</>", "<?x?>", "<script>var a='<p>';</script>", "<style>p{}</style>", "<title> One &amp; two </title>", "<title></title>", "<title>Second</title>",
    "<textarea>in &amp; <b>area</textarea>", "<xmp>x &amp; y</xmp>", "<noscript><a href=/hidden>n</a></noscript>", "<a href=/one>", "</a>", "<a href='two' href=three>", "<a name=n>", "<a href=#in>", "<a href=' http://o.example/x '>", "<a href=mailto:x@y/>",
    "<html lang=en>", "<html lang=''>", "<meta name=description content='D &amp; d'>", "<meta content=T property=og:title />", "<meta property=og:url content=>", "<ul>", "<li>", "</li>", "</ul>", "<li/>", "é 日本 ",
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    bodies = ["".join(rng.choices(BITS, k=rng.randrange(1, 60))) for _ in range(250)]
    bodies += [None, "", "plain", "<a href=/cut", "<title>open", "<nav>never shut", "</nav></nav>shown<nav>no</nav>yes", "<ul>" * 300 + "x" + "</ul>" * 200, "<p>" * 3 + "</p>" * 5 + "<p></p>"]
    rows = [(i, None if i % 40 == 7 else f"http://h{i}.example/a/b", b) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return rows, pages, TokenStore.make(pages, buckets=4)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_readers_equal_the_page_operators(corpus):
    _, pages, store = corpus
    filled = pages.na.fill("", ["html"])
    same(store.titles(), P.page_titles(filled))
    same(store.links(), P.page_links(filled))
    for dialect in ("fast", "browser"):
        same(store.metadata(dialect), P.page_metadata(filled, dialect=dialect))
    same(store.text(), P.page_text(filled))


def test_readers_neither_parse_nor_shuffle(corpus):
    store = corpus[2]
    for df in (store.titles(), store.links(), store.metadata(), store.text(), store.elements("ul")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "<!--" not in plan


def test_intervals_equal_a_stack(corpus):
    rows, pages, store = corpus
    want = set()
    for r in P.tokens(pages.na.fill("", ["html"])).select("page_id", "pos", "kind", "tag").orderBy("page_id", "pos").collect():
        if r.pos == 0:
            stacks = {}
        if r.tag is None or r.tag in VOID_TAGS:
            continue
        if r.kind == "start":
            stacks.setdefault(r.tag, []).append(r.pos)
        elif r.kind == "end" and stacks.get(r.tag):
            level = len(stacks[r.tag])
            want.add((r.page_id, r.tag, stacks[r.tag].pop(), r.pos, level))
    names = {re.sub(r"[<>/ ].*", "", b[1:]).lower() for b in BITS if re.match("<[a-zA-Z]", b)} | {"p"}
    got = {tuple(r) for r in store.elements(*names).collect()}
    assert got == want and len(want) > 500


def test_no_pages(spark):
    store = TokenStore.make(spark.createDataFrame([], "page_id long, url string, html string"), buckets=2)
    assert store.titles().count() == 0 and store.links().count() == 0 and store.metadata().count() == 0 and store.text().count() == 0
