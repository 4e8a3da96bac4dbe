"""Range and suffix joins against plain loops over their tables."""

import ipaddress
import random

from pagewright.functions.sql import fn as F
from pagewright.operators import domains, ranges, routing, safety


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def number(text):
    ip = ipaddress.ip_address(text)
    return int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)


def plain_range(text, table):
    """(prefix length, row) of the longest prefix, the least row of equal ones."""
    best = None
    for row in table:
        ip, _, bits = row[0].partition("/")
        try:
            low, n = number(ip), number(text)
            length = (int(bits) if bits else (128 if ":" in ip else 32)) + (0 if ":" in ip else 96)
        except ValueError:
            continue
        if length <= 128 and low >> (128 - length) == n >> (128 - length) and (best is None or (-length, row) < best):
            best = -length, row
    return best and best[1]


def test_ranges_equal_a_scan(spark):
    rng = random.Random(1)
    four = lambda: f"10.{rng.choice([0, 1, 255])}.{rng.randrange(4)}.{rng.randrange(256)}"
    six = lambda: f"2001:db8:{rng.randrange(3):x}::{rng.choice(['', '1', 'ffff:1', '8000:0'])}".replace(":::", "::")
    table = [(f"{four()}/{rng.randrange(8, 33)}", i) for i in range(60)] + [(f"{six()}/{rng.randrange(30, 129)}", i) for i in range(60)]
    table += [("10.0.0.0/8", 500), ("10.0.0.0/8", 501), ("10.9.9.9/8", 1), ("2001:db8::/32", 7), ("::ffff:10.255.0.0/112", 8), ("10.0.0.1", 9), ("::/0", 10), ("10.0.0.0/33", 11), ("junk", 12), (None, 13), ("10.0.0.0/", 14), ("1.2.3/8", 15), ("::1/129", 16)]
    asked = [four() for _ in range(150)] + [six() for _ in range(100)] + ["::ffff:10.255.0.9", "::ffff:a00:1", "8.8.8.8", "::1", "junk", "", None, "10.0.0.256", "10.0.0.1", "10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, ip string")
    got = ranges.match_ranges(df, "ip", spark.createDataFrame(table, "cidr string, n int"))
    readable = [t for t in table if t[0] is not None and not t[0].endswith("/")]

    def want(ip):
        try:
            number(ip)
        except ValueError:
            return None
        return plain_range(ip, readable)

    out = got.collect()
    assert len(out) == len(asked) and {(r.i, r.range and tuple(r.range)) for r in out} == {(i, want(ip or "")) for i, ip in enumerate(asked)}
    assert sum(r.range is not None for r in out) > 200
    assert ranges.match_ranges(df, "ip", spark.createDataFrame([], "cidr string, n int")).filter("range IS NOT NULL").count() == 0
    assert ranges.match_ranges(df.limit(0), "ip", spark.createDataFrame(table, "cidr string, n int")).count() == 0


def test_reserved_ranges_as_a_table(spark):
    """The shipped ranges, given as a table, decide as the fixed ones; a row more changes that."""
    dns = spark.createDataFrame([("ok.com", 0, "93.1.1.1"), ("in.com", 0, "10.0.0.1"), ("six.com", 0, "fe80::2"), ("mixed.com", 0, "8.8.8.8"), ("mixed.com", 1, "::1"), ("junk.com", 0, "zz")], "host string, pos int, ip string")
    urls = ["https://ok.com/", "http://in.com/x", "http://six.com", "http://mixed.com", "http://junk.com", "http://127.0.0.1/", "http://[::1]/", "http://8.8.8.8/", "ftp://ok.com", "http://gone.com", "", None]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    table = ranges.reserved_ranges(spark, "gateway")
    show = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert show(safety.validate_urls(df, "url", dns, ranges=table)) == show(safety.validate_urls(df, "url", dns))
    more = safety.validate_urls(df, "url", dns, ranges=table.union(spark.createDataFrame([("93.0.0.0/8", "own"), ("8.8.8.8", "own")], table.schema)))
    assert {r.i for r in more.collect() if r.url_ok} == set() and {r.url_error for r in more.collect() if r.i in (0, 7)} == {safety.PRIVATE}


def plain_name(host, table, wanted):
    found = []
    for name, match, which in table:
        inside = host.endswith("." + name)
        if which == wanted and name and {"domain": host == name or inside, "below": inside, "exact": host == name, "first": host.startswith(name + ".")}[match]:
            found.append((name.count("."), ["first", "below", "exact", "domain"].index(match), name))
    return max(found)[2] if found else None


def test_suffixes_equal_a_scan(spark):
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "www", "docs", "x"])
    name = lambda: ".".join(label() for _ in range(rng.randrange(1, 5)))
    table = [(name(), rng.choice(["domain", "below", "exact", "first"]), rng.choice(["protected", "static_doc"])) for _ in range(120)] + [("", "domain", "protected")]
    hosts = [name() for _ in range(300)] + ["", None, ".", "a..b", "A.B.X", "a.b.x.", "b." * 5000 + "a", "c" * 300]
    df = spark.createDataFrame(list(enumerate(hosts)), "i int, host string")
    out = domains.match_domains(df, "host", spark.createDataFrame(table, "name string, match string, list string")).collect()
    assert len(out) == len(hosts)
    for r in out:
        assert r.protected == plain_name((r.host or "").lower(), table, "protected"), r
        assert r.static_doc == plain_name((r.host or "").lower(), table, "static_doc"), r
    assert sum(r.protected is not None for r in out) > 100
    assert domains.match_domains(df, "host", spark.createDataFrame([], "name string, match string, list string")).filter("protected IS NOT NULL").count() == 0


def test_a_hundred_thousand_domains(spark):
    """A third of all hosts below one name; the plan joins on equal keys only."""
    names = spark.range(100_000).selectExpr("concat('d', id, '.example', id % 7, '.com') AS name", "'domain' AS match", "'protected' AS list").union(spark.createDataFrame([("hot.com", "domain", "protected")], "name string, match string, list string"))
    hosts = spark.range(30_000).selectExpr("id AS i", "CASE id % 3 WHEN 0 THEN concat('h', id, '.hot.com') WHEN 1 THEN concat('www.d', id * 5, '.example', id * 5 % 7, '.com') ELSE concat('n', id, '.org') END AS host")
    out = domains.match_domains(hosts, "host", names)
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)
    counts = {r["k"]: r["n"] for r in out.selectExpr("CASE WHEN protected = 'hot.com' THEN 'hot' WHEN protected IS NULL THEN 'none' WHEN host = concat('www.', protected) THEN 'own' END AS k").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert counts == {"hot": 10_000, "own": 6667, "none": 13_333}


def test_shipped_domains_route_alike(spark):
    urls = ["https://www.linkedin.com/in/a", "https://X.com", "http://notx.com/", "https://shop.amazon.com/console", "https://proj.readthedocs.io/en/", "https://readthedocs.io/", "https://docs.a.b/c", "https://docs.x.com/", "https://apidoc.q/", "https://apidocs.q/",
            "https://en.wikipedia.org/wiki/X", "https://de.wikipedia.org/wiki/X", "https://a.com/app/", "https://github.com/o/r", "not a url", "", "https://wiki/", "http://man.x/#/a"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    fixed = df.select("i", routing.classify_url(F.col("url")).alias("route").col).orderBy("i").collect()
    assert domains.classify_urls(df, "url", domains.default_domains(spark)).select("i", "route").orderBy("i").collect() == fixed
    more = domains.default_domains(spark).union(spark.createDataFrame([("a.com", "domain", "protected")], "name string, match string, list string"))
    assert domains.classify_urls(df, "url", more).filter("i = 12").first().route.reason == "protected domain: a.com"
