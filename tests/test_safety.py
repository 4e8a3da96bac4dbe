import ipaddress
import random

import pytest

from pagewright.functions.addresses import host_is_private_literal, ipv4_number, ipv6_hex, is_private_address
from pagewright.functions.sql import fn as F
from pagewright.operators import safety

X = F.col("x")
PRIVATE = "127.0.0.1 127.255.255.255 10.0.0.1 172.16.0.1 172.31.255.255 192.168.1.1 169.254.169.254 0.0.0.0 ::1 :: fe80::1 fc00::1 fd00::1 ::ffff:10.0.0.1 ::ffff:a00:1".split()
PUBLIC = "8.8.8.8 1.1.1.1 172.15.255.255 172.32.0.0 11.0.0.1 192.169.0.1 100.128.0.1 2607:f8b0:4004:800::200e ::2 ::ffff:93.184.216.34".split()


@pytest.mark.parametrize("dialect", ["gateway", "fast", "browser", "strict"])
def test_ranges(evaluate, dialect):
    assert all(evaluate(PRIVATE, is_private_address(X, dialect)))
    assert not any(evaluate(PUBLIC, is_private_address(X, dialect)))


def test_dialects(evaluate):
    odd = ["100.64.0.1", "255.255.255.255", "not-an-ip", "", "224.0.0.5", "ff02::1"]
    assert evaluate(odd, is_private_address(X, "browser")) == [True, True, True, True, True, False]
    assert evaluate(odd, is_private_address(X, "gateway")) == [False, False, None, None, True, True]
    assert evaluate(odd, is_private_address(X, "fast")) == [False, False, None, None, False, False]


def test_parsing_equals_ipaddress(evaluate):
    rnd = random.Random(3)
    texts = [str(ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.getrandbits(128))) for _ in range(300)]
    texts += ["".join(rnd.choice(["::", ":", "1", "abcd", "0", "12345", "g", "1.2.3.4", "300.1.1.1"]) for _ in range(rnd.randrange(1, 9))) for _ in range(2000)]
    for text, four, six in zip(texts, evaluate(texts, ipv4_number(X)), evaluate(texts, ipv6_hex(X))):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            ip = None
        assert four == (int(ip) if ip and ip.version == 4 else None), text
        assert six == (f"{int(ip):032x}" if ip and ip.version == 6 else None), text


def test_host_literal(evaluate):
    hosts = ["127.0.0.1", "[::1]", "example.com", "8.8.8.8", "10.example.com"]
    assert evaluate(hosts, host_is_private_literal(X)) == [True, True, False, False, False]


def test_url_safety(spark):
    dns = spark.createDataFrame([("ok.com", 1, "2606:4700::1"), ("ok.com", 0, "93.1.1.1"), ("mixed.com", 0, "8.8.8.8"), ("mixed.com", 1, "10.0.0.1"), ("junk.com", 0, "zzz")], "host string, pos int, ip string")
    cases = {
        "https://ok.com/x": (None, "93.1.1.1"),
        "http://mixed.com": (safety.PRIVATE, None),
        "http://junk.com": (safety.NO_ADDRESS + "junk.com", None),
        "http://nowhere.com": (safety.NO_ADDRESS + "nowhere.com", None),
        "ftp://ok.com": (safety.BAD_SCHEME, None),
        "javascript:alert(1)": (safety.BAD_SCHEME, None),
        "ok.com": (safety.BAD_URL, None),
        "": (safety.BAD_URL, None),
        "http:///x": (safety.NO_HOST, None),
        "http://127.0.0.1:8080/": (safety.PRIVATE, None),
        "http://[::1]/": (safety.PRIVATE, None),
        "http://8.8.4.4/": (None, "8.8.4.4"),
        "http://ok.com#f": (safety.BAD_URL, None),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, url string")
    got = safety.validate_urls(df, "url", dns).orderBy("i").collect()
    assert [(r.url_error, r.pinned_ip) for r in got] == list(cases.values())


def test_browser_verdict(spark):
    rows = [("http://h/", "8.8.8.8", None), ("file:///x", "8.8.8.8", "scheme"), ("http://10.0.0.1/", "8.8.8.8", "hostname"), ("http://h/", None, "required"), ("http://h/", "192.168.0.1", "resolved IP"), ("zz", "8.8.8.8", "invalid")]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, url string, ip string")
    got = df.select("i", safety.browser_verdict(F.col("url"), F.col("ip")).alias("e").col).orderBy("i").collect()
    for r, (_, _, part) in zip(got, rows):
        assert (r.e is None) if part is None else part in r.e


def test_redirects(spark):
    dns = spark.createDataFrame([("ok.com", 0, "8.8.8.8"), ("bad.com", 0, "10.0.0.1")], "host string, pos int, ip string")
    hops = [(1, h, "http://ok.com/") for h in range(1, 5)] + [(2, h, "http://ok.com/") for h in range(1, 6)] + [(3, 1, "http://ok.com/"), (3, 2, "http://bad.com/")]
    got = safety.redirect_verdicts(spark.createDataFrame(hops, "chain_id int, hop int, url string"), dns).orderBy("chain_id").collect()
    assert [(r.hops, r.error) for r in got] == [(4, None), (5, "too many redirects"), (2, "redirect to private address blocked")]
