from html.parser import HTMLParser

from pagewright.functions.sql import fn as F
from pagewright.functions import html as H
from pagewright.operators import pages as P

X = F.col("x")


def _table(spark, htmls, url="https://pier.example/log"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id int, url string, html string")


def test_links(spark):
    html = """<a href="/tides">1</a><A HREF=https://buoy.example/7>2</A><a href="#noon"><a href="javascript:tide()"><a href="mailto:crew@pier.example">
    <a href=""><!-- <a href=/no> --><script>"<a href=/no2>"</script><a title="x>y" href='/p?a=1&amp;b=2' href=/dup><a href="/tides#z"><div t="<a href=/no3>"><a href="/cut"""
    got = [r.link for r in P.page_links(_table(spark, [html])).orderBy("pos").collect()]
    assert got == ["https://pier.example/tides", "https://buoy.example/7", "https://pier.example/p?a=1&b=2", "https://pier.example/dup"]


def test_relative_links(spark):
    got = P.page_links(_table(spark, ['<a href="noon/high"></a><a href=" ../berths ">'], "https://pier.example/log/may")).orderBy("pos").collect()
    assert [r.link for r in got] == ["https://pier.example/log/noon/high", "https://pier.example/berths"]


def test_link_filter(evaluate):
    links = ["https://example.com/a", "https://other.com/b", "https://example.com:8080/c", "ftp://example.com/d", "https://Example.com/e", "https://example.com/f.PDF", "https://example.com/about"]
    none = F.array().cast("array<string>")
    assert evaluate(links, P.keep_link(X, F.lit("example.com"), none, none)) == [True, False, True, False, False, False, True]
    followed = P.followed_links(F.lit("https://example.com/"), F.array(*links), F.lit("example.com"), none, none)
    assert evaluate(["x"], followed) == [["https://example.com/a", "https://example.com:8080/c", "https://example.com/about"]]


def test_titles(evaluate):
    htmls = ["<title>Tide log</title>", "<title>\t North pier </title>", "<b>no title</b>", "<title></title><title>B &lt;i&gt;</title>", "<!-- <title>no</title> --><TITLE a=b>Y</title >"]
    assert evaluate(htmls, P.crawl_title(H.tag_array(X))) == ["Tide log", "North pier", "", "B <i>", "Y"]


def test_metadata(spark):
    full = """<html lang="en"><head><title> T </title><meta name="description" content="D"><meta property="og:title" content="OT"/>
    <meta property='og:description' content=OD><meta property="og:image" content="I"><meta property="og:url" content="U"><meta name="description" content="second">"""
    rows = P.page_metadata(_table(spark, [full, "<html><head></head></html>", '<html lang=""><meta property="og:title" content="OT"><meta name=Description content=x>'])).orderBy("page_id").collect()
    assert tuple(rows[0])[1:] == ("T", "D", "en", "OT", "OD", "I", "U")
    assert tuple(rows[1])[1:] == (None,) * 7
    assert tuple(rows[2])[1:] == ("OT", None, "", "OT", None, None, None)
    browser = P.page_metadata(_table(spark, [full, "<p>"]), dialect="browser").orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in browser] == [("T", "D", "en"), ("", "", "")]


def test_tokens_match_a_parser(spark):
    html = "<!doctype html><p class=a>x &amp; y<br/><b>z</b><!-- c --><script>if (a<b) '</p>'</script><i>w</i>"
    seen = []

    class Parser(HTMLParser):
        def handle_starttag(self, tag, attrs):
            seen.append(("open", tag))

        def handle_endtag(self, tag):
            seen.append(("close", tag))

    Parser().feed(html)
    rows = P.tokens(_table(spark, [html])).orderBy("pos").collect()
    got = []
    for r in rows:
        if r.kind in ("start", "raw", "selfclosing"):
            got.append(("open", r.tag))
        if r.kind in ("end", "raw", "selfclosing"):
            got.append(("close", r.tag))
    assert got == [s for s in seen if s != ("close", "br")] + [] or got == seen
    assert [r.text for r in rows if r.kind == "text"] == ["x & y", "z", "w"]


def test_page_text(spark):
    html = "<title>t</title><nav>n<nav>m</nav>n</nav><p>a</p></nav><aside>x</aside>b <svg><g/>s</svg>c<style>p{}</style><footer>f"
    assert P.page_text(_table(spark, [html])).first().text == "a b c"


def test_hostile_markup_is_linear(evaluate):
    htmls = ["<a " + "x=1 " * 50_000 + ">", "<" * 100_000, "<!--" + "-" * 100_000, "<script>" + "</scrip" * 20_000, '<a href="' + "y" * 200_000, " " * 200_000 + "x"]
    assert len(evaluate(htmls, F.size(H.token_array(X)))) == len(htmls)


def test_formats(spark):
    df = spark.createDataFrame([("html",), ("markdown",), ("pdf",), (None,)], "f string")
    out = P.output_columns(F.col("f"), F.lit("<p>"), F.lit("md"))
    got = df.select(out.alias("o").col, P.is_valid_format(F.col("f")).alias("v").col).collect()
    assert [(r.o.content, r.o.markdown) for r in got] == [("<p>", ""), ("", "md"), ("", "md"), ("", "md")]
    assert [r.v for r in got] == [True, True, False, None]
