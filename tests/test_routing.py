from pagewright.functions.sql import fn as F
from pagewright.operators import routing as R

X = F.col("x")


def test_gateway_routes(evaluate):
    cases = {
        "https://de.linkedin.com/company/tide-gauge": ("stealth", 0.9, ""),
        "https://x.com/harbour_watch": ("stealth", 0.9, ""),
        "https://netflix.com/title/80": ("fast", 0.5, ""),
        "https://tide-tables.readthedocs.io/api.html": ("fast", 0.9, ""),
        "https://docs.harbour.example/moorings/7": ("fast", 0.9, ""),
        "https://harbour.example/dashboard/berths?b=2": ("browser", 0.7, ""),
        "https://harbour.example/approach": ("fast", 0.5, ""),
        "https://harbour.example/m/#/berth/12": ("browser", 0.8, ""),
        "https://harbour.example/#!/tides": ("browser", 0.8, ""),
        "https://www.github.com/tide-gauge/logger/wiki": ("fast", 0.9, "github_repo"),
        "https://github.com/settings/keys": ("fast", 0.5, ""),
        "https://github.com/tide-gauge": ("fast", 0.5, ""),
        "https://github.com.harbour.example/tide-gauge/logger": ("fast", 0.5, ""),
        "https://news.ycombinator.com/item?id=90210": ("fast", 0.9, "hn_thread"),
        "https://news.ycombinator.com/item?p=2&id=8": ("fast", 0.9, "hn_thread"),
        "https://news.ycombinator.com/item?id=tide": ("fast", 0.5, ""),
        "http://north pier/": ("fast", 0.3, ""),
    }
    got = evaluate(list(cases), R.classify_url(X))
    assert [(r.tier, r.confidence, r.strategy) for r in got] == list(cases.values())


def test_router_header(evaluate):
    route = R.classify_url(X, "router", F.map("CONTENT-TYPE", "application/json"))
    (r,) = evaluate(["https://harbour.example/levels.json"], route)
    assert (r.tier, r.confidence, r.reason) == ("fast", 0.9, "non-HTML content-type: application/json")


def test_responses(spark):
    html = "text/html"
    rows = [
        (200, {"content-type": "application/json"}, "[4.1, 3.9]", "fast", 0.95),
        (403, {"content-type": html, "CF-MITIGATED": "1"}, "<p>closed", "stealth", 0.9),
        (200, {"X-DataDome": "p7"}, "<p>quay", "stealth", 0.9),
        (403, {"content-type": html}, "<b>checking YOUR browser</b>", "stealth", 0.9),
        (503, {"content-type": html}, "<h1>Just a moment</h1> please", "stealth", 0.9),
        (200, {"content-type": html}, "<script>cf_chl_opt={}</script>", "stealth", 0.8),
        (200, {"content-type": html}, "<p>access denied" + " pier" * 12_000, "fast", 0.8),
        (200, {"content-type": html}, '<main><div id="root"></div></main>', "browser", 0.85),
        (200, {"content-type": html}, "<script>a()</script><p>.</p><script>b()</script>", "browser", 0.7),
        (200, {"content-type": html}, "tide " * 150 + '<div id="app">', "browser", 0.75),
        (200, {"content-type": html}, "<p>high water at noon</p>" * 40, "fast", 0.8),
        (200, {}, "ebb", "fast", 0.5),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, status int, headers map<string,string>, body string")
    got = df.select("i", R.classify_response(F.col("status"), F.col("headers"), F.col("body")).alias("r").col).orderBy("i").collect()
    assert [(g.r.tier, g.r.confidence) for g in got] == [r[3:] for r in rows]


def test_tier_gate(spark):
    df = spark.createDataFrame([("fast", []), ("browser", []), ("browser", ["fast", "browser"]), ("stealth", ["fast"]), ("fast", None)], "tier string, allowed array<string>")
    got = df.select(R.is_tier_allowed(F.col("tier"), F.col("allowed")).alias("a").col, R.queue_for_tier(F.col("tier")).alias("q").col).collect()
    assert [r.a for r in got] == [True, False, True, False, True]
    assert [r.q for r in got] == ["scrape_jobs", "browser_jobs", "browser_jobs", "stealth_jobs", "scrape_jobs"]
