import random
from urllib.parse import parse_qs, urlparse

from pagewright.functions import urls as U
from pagewright.functions.sql import fn as F
from pagewright.functions.text import decode_entities, let

X = F.col("x")


def test_normalize(evaluate):
    cases = {
        "https://pier.example/log#noon": "https://pier.example/log",
        "https://pier.example/log?day=4&h=2": "https://pier.example/log?day=4&h=2",
        "https://pier.example/a/b///": "https://pier.example/a/b",
        "https://pier.example": "https://pier.example",
        "https://pier.example/log?up=/x//": "https://pier.example/log?up=/x",
        "HTTP://Host/für x": "http://Host/f%C3%BCr%20x",
        "http://h/%zz/": "http://h/%zz/",
        "http://h/a(b)[c]": "http://h/a(b)[c]",
        "http://h/é(b)%2F%41": "http://h/%C3%A9%28b%29/A",
    }
    assert evaluate(list(cases), U.normalize_url(X)) == list(cases.values())


def test_resolve(evaluate):
    base = "https://example.com/docs/intro?x=1#y"
    cases = {
        "sub/page": "https://example.com/docs/sub/page",
        "../other": "https://example.com/other",
        "../../../up": "https://example.com/up",
        "/abs": "https://example.com/abs",
        "?q=2": "https://example.com/docs/intro?q=2",
        "#f": "https://example.com/docs/intro?x=1",
        "//other/x": "https://other/x",
        "https://z/../y/./": "https://z/y/",
        "./": "https://example.com/docs/",
        "..": "https://example.com/",
        "a//b/../c": "https://example.com/docs/a//c",
        "mailto:a@b": "mailto:a@b",
        "/für": "https://example.com/f%C3%BCr",
        "%zz": None,
        "1a:b": None,
    }
    resolved = let(U.base_parts(F.lit(base)), lambda b: U.resolve_url(b, X))
    assert evaluate(list(cases), resolved) == list(cases.values())


def test_gateway_rejects(evaluate):
    bad = ["1http://x", "http://a b.com/", "http://h/%zz", "http://h:80a/", "http://[::1", "http://h/\x07", ":x", "http://u^@h/", "http://%41/"]
    good = ["", "x", "/p", "http://[::1]:80/x", "http://h:/", "mailto:a@b", "http://u:p@h/", "http://h/a b"]
    parts = U.url_parts(X)
    assert not any(p.ok for p in evaluate(bad, parts))
    assert all(p.ok for p in evaluate(good, parts))


def test_router_reading_equals_urlparse(evaluate):
    rnd = random.Random(5)
    pieces = ["http", "HTTPS", "ftp", "x-1", ":", "//", "/", "?", "#", ";", "@", "h.com", "[::1]", "[", "]", ":80", "a", "%41", " ", "\t", "é", "=", "&", ".."]
    urls = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 9))) for _ in range(3000)]
    got = evaluate(urls, U.url_parts(X, U.ROUTER))
    for url, p in zip(urls, got):
        try:
            want = urlparse(url)
            host = want.hostname or ""
        except ValueError:
            assert not p.ok, url
            continue
        assert p.ok, url
        assert (p.scheme, p.host, p.path, p.query, p.fragment) == (want.scheme, host.lower(), want.path, want.query, want.fragment), url


def test_query_keys_equal_parse_qs(evaluate):
    rnd = random.Random(6)
    pieces = ["a", "b", "=", "&", "%41", "%zz", "+", "", ";", "1"]
    queries = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 14))) for _ in range(1500)]
    assert evaluate(queries, U.query_key_count(X)) == [len(parse_qs(q)) for q in queries]


def test_skip(evaluate):
    skipped = {
        "/shop/cart": "junk URL pattern: shopping cart",
        "/member/login?to=berth": "junk URL pattern: login page",
        "/tide-table-2024.pdf": "binary/non-HTML file extension: .pdf",
        "/charts/north.ZIP": "binary/non-HTML file extension: .zip",
        "/find?depth=4&width=9&pier=n&month=5&boat=k&free=y&sort=x": "excessive query parameters: 7",
    }
    kept = ["/moorings", "/find?depth=4&pier=n", "/find?a=1&b=2&c=3&d=4&e=5", "/cartography", "/tide-table.pdf.html"]
    got = evaluate(["https://pier.example" + p for p in [*skipped, *kept]], U.skip_decision(X))
    assert [r.reason for r in got[: len(skipped)]] == list(skipped.values())
    assert [r.skip for r in got] == [True] * len(skipped) + [False] * len(kept)


def test_redact(evaluate):
    cases = ["https://u:p@Example.com/a b?q#f", "not-a-url", "http://h/%zz?x", "https://h:443"]
    assert evaluate(cases, U.redact_url(X)) == ["https://Example.com/a%20b", "not-a-url", "http://h/%zz?x", "https://h:443"]
    assert evaluate(cases, U.redact_url(X, "browser")) == ["https://example.com/a%20b", "<invalid-url>", "http://h/%zz", "https://h/"]


def test_link_patterns(evaluate):
    none, docs = F.array().cast("array<string>"), F.array("/docs/")
    urls = ["http://h/docs/a", "http://h/blog", "http://h/docs/login"]
    assert evaluate(urls, U.passes_patterns(X, docs, none)) == [True, False, True]
    assert evaluate(urls, U.passes_patterns(X, none, F.array("/login"))) == [True, True, False]
    assert evaluate(urls, U.passes_patterns(X, docs, F.array("/login"))) == [True, False, False]


def test_entities(evaluate):
    text = ["a &amp; b &copy;x &copyx &notit; &#65;&#x41;&#128;&#0;&#xD800; &nosuch; & &;", "&lt=1 &amp", "plain"]
    assert evaluate(text, decode_entities(X)) == ["a & b ©x ©x ¬it; AA€\ufffd\ufffd &nosuch; & &;", "<=1 &", "plain"]
    assert evaluate(["&lt=1", "&copyx", "&amp;x"], decode_entities(X, attribute=True)) == ["&lt=1", "&copyx", "&x"]
