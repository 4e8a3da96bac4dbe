import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from pagewright.operators import admission as A, jobs as J, health as M


def test_signature_golden_vector(spark):
    df = spark.createDataFrame([("o", "p", "1", "POST", "/v1/scrape?x=1")], "a string, b string, c string, d string, e string")
    sig = df.select(A.sign_plan("s", *[F.col(c) for c in "abcde"])).first()[0]
    assert sig == "3a041c91b77cde97262a3e9ece74ea0a44d81ebcdd03ea26ce230c015253b273"
    long = "k" * 100
    assert df.select(A.hmac_sha256(long, F.col("e"))).first()[0] == hmac.new(long.encode(), b"/v1/scrape?x=1", "sha256").hexdigest()


def test_signed_plan_verdicts(spark):
    secret, owner, now = "x" * 32, hashlib.sha256(b"k").hexdigest(), 1_700_000_000
    plan = base64.b64encode(json.dumps({"name": "pro", "allowed_tiers": ["fast"], "max_crawl_pages": 7}).encode()).decode()

    def row(want, owner=owner, plan=plan, ts=str(now), uri="/u", sign_uri=None, sig=None):
        text = "\n".join([owner, plan, ts, "POST", sign_uri or uri])
        return (want, owner, plan, ts, "POST", uri, hmac.new(secret.encode(), text.encode(), "sha256").hexdigest() if sig is None else sig)

    bad_types = base64.b64encode(b'{"max_crawl_pages": "7"}').decode()
    rows = [
        row("trusted"), row("trusted", ts=str(now - 30)), row("stale_timestamp", ts=str(now - 31)), row("stale_timestamp", ts=str(now + 300)),
        row("bad_signature", sign_uri="/other"), row("bad_signature", sig=""), row("bad_timestamp", ts="1.5"), row("bad_owner", owner=owner.upper()),
        row("bad_owner", owner="abc"), row("bad_plan_encoding", plan="%%%"), row("bad_plan_json", plan=base64.b64encode(b"[1]").decode()),
        row("bad_plan_json", plan=bad_types), row("trusted", plan=base64.b64encode(b"null").decode()), ("direct", "", "", "", "GET", "/u", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, want string, owner string, plan_b64 string, ts string, method string, uri string, signature string")
    got = A.signed_plan_verdicts(df.withColumn("now", F.lit(now)), secret).orderBy("i").collect()
    assert [r.verdict for r in got] == [r[0] for r in rows]
    assert got[0].plan.max_crawl_pages == 7 and got[4].plan is None


def test_anonymize_ip(evaluate):
    ips = ["192.168.1.42", "::1", "2001:db8::1", "weird", "", "1.2.3", "a.b.c.d"]
    assert evaluate(ips, A.anonymize_ip(F.col("x"))) == ["192.168.1.0", "::0", "2001:db8::0", "redacted", "redacted", "redacted", "a.b.c.0"]


def test_retention(evaluate):
    hours = [-1, 0, 24, 720, 1 << 40, None]
    ttl = A.result_ttl_seconds(F.col("x"))
    assert evaluate(hours, ttl, "bigint") == [0, 0, 24 * 3600, 720 * 3600, 720 * 3600, 0]
    assert evaluate(hours, A.effective_ttl_seconds(ttl), "bigint") == [3600, 3600, 24 * 3600, 720 * 3600, 720 * 3600, 3600]


def test_plan_defaults_and_caps(spark):
    plans = spark.createDataFrame([("o1", 500, ["fast", "browser"], True, 60, 5, 50, 24)], "owner string, max_credits_per_month long, allowed_tiers array<string>, can_extract boolean, max_rate_per_min long, max_concurrency long, max_crawl_pages long, result_retention_hours long")
    plans = plans.selectExpr("*", "'pro' AS name", "false AS can_webhook", "false AS has_sla", "false AS can_overage", "1L AS max_bandwidth_gb")
    asked = spark.createDataFrame([(1, "o1", 5000, 0, 0, ""), (2, "o2", 0, 99, 999, "html"), (3, None, 7, 2, 60, "text")], "i int, owner string, max_pages int, max_depth int, max_timeout int, format string")
    got = A.crawl_caps(A.with_plan(asked, "owner", plans)).orderBy("i").collect()
    assert [(r.max_pages, r.max_depth, r.max_timeout, r.format, r.plan.name) for r in got] == [(50, 3, 300, "markdown", "pro"), (10, 10, 600, "html", "free"), (7, 2, 60, "text", "free")]
    assert got[1].plan.allowed_tiers == ["fast"] and got[1].plan.can_extract is False
    fixed = A.crawl_caps(A.with_plan(asked, "owner", plans), fixed_timeout=True).filter("i = 3").first()
    assert fixed.max_timeout == 300


def test_trusted_plan_wins(spark):
    plans = spark.createDataFrame([("o", "pro")], "owner string, name string")
    for c, t in A._PLAN_TYPES.items():
        if c != "name":
            plans = plans.withColumn(c, F.lit(None).cast(t))
    asked = spark.createDataFrame([(1, "o")], "i int, owner string").withColumn("given", A.free_plan())
    assert A.with_plan(asked, "owner", plans, trusted="given").first().plan.name == "free"


def test_extract_needs_endpoint(spark):
    asked = spark.createDataFrame([(1, "extract", "https://ok.com/", "", "{}"), (2, "scrape", "https://ok.com/", "", "")], "request_id int, kind string, url string, format string, extract_schema string").withColumn("plan", A.free_plan())
    dns = spark.createDataFrame([("ok.com", 0, "8.8.8.8")], "host string, pos int, ip string")
    got = A.admit(asked, dns, extraction_available=False).orderBy("request_id").collect()
    assert [(r.http_code, r.stream) for r in got] == [(503, None), (202, "scrape_jobs")]
    assert A.admit(asked, dns).orderBy("request_id").first().http_code == 403


def test_keys_and_log(spark):
    known = spark.createDataFrame([(hashlib.sha256(b"good").hexdigest(),)], "key_hash string")
    asked = spark.createDataFrame([("good",), ("bad",), ("",), (None,)], "k string")
    got = {r.k: r.key_error for r in A.check_keys(asked, "k", known).collect()}
    assert got == {"good": None, "bad": "invalid API key", "": "missing API key", None: "missing API key"}


def test_payload_leaves_out_empty_fields(spark):
    df = spark.createDataFrame([("http://h/?a=1&b=<2>", "markdown", '{ "t" : "a b" }', "", 0, False), ("http://h/", "", "", "#id", 5, True)], "url string, format string, extract_schema string, wait_for string, timeout int, wait boolean")
    got = [r[0] for r in df.select(J.scrape_payload()).collect()]
    assert got[0] == '{"url":"http://h/?a=1\\u0026b=\\u003c2\\u003e","format":"markdown","extract_schema":{"t":"a b"}}'
    assert json.loads(got[0])["url"] == "http://h/?a=1&b=<2>"
    assert got[1] == '{"url":"http://h/","wait_for":"#id","timeout":5,"wait":true}'


def test_entries(spark):
    entries = spark.createDataFrame([("1-0", {"url": "u", "job_id": "j"}), ("2-0", {"url": "u"}), ("3-0", {"job_id": "j"}), ("4-0", {}), ("5-0", {"url": "", "job_id": "j"})], "entry_id string, fields map<string,string>")
    good, bad = J.split_entries(entries)
    assert sorted((r.entry_id, r.job_id) for r in good.collect()) == [("1-0", "j"), ("2-0", "2-0"), ("5-0", "j")] and bad.count() == 2
    good, bad = J.split_entries(entries, "browser")
    assert [r.entry_id for r in good.collect()] == ["1-0"] and bad.count() == 4


def test_trim_and_orphans(spark):
    entries = spark.range(1000).selectExpr("id AS entry_id", "if(id % 3 = 0, 'a', 'b') AS stream", "timestamp_seconds(id div 10) AS enqueued_at")
    kept = J.newest_per_stream(entries, 20).groupBy("stream").agg(F.count("*").alias("n"), F.min("entry_id").alias("low")).orderBy("stream").collect()
    assert [(r.n, r.low) for r in kept] == [(20, 942), (20, 970)]
    ids = spark.range(1000).selectExpr("concat(id div 13, '-', id % 13) AS entry_id", "'a' AS stream", "timestamp_seconds(id div 300) AS enqueued_at", "id")
    kept = {r.id for r in J.newest_per_stream(ids, 25).collect()}
    assert kept == set(range(975, 1000))
    nulls = ids.withColumn("enqueued_at", F.when(F.col("id") >= 5, F.col("enqueued_at"))).withColumn("stream", F.when(F.col("id") % 2 == 0, "a"))
    assert sorted(r.id for r in J.newest_per_stream(nulls, 499).collect()) == sorted({*range(3, 1000, 2), *range(2, 1000, 2)})
    claims = ids.selectExpr("stream", "'g' AS grp", "entry_id", "70000L AS idle_ms", "id")
    none = claims.filter("false").select("stream", "grp", "entry_id")
    assert {r.id for r in J.orphaned_entries(claims, none, 30).collect()} == set(range(30))
    claims = spark.range(500).selectExpr("'s' AS stream", "'g' AS grp", "id AS entry_id", "if(id % 2 = 0, 60000L, 59999L) AS idle_ms")
    acks = claims.filter("entry_id % 4 = 0").select("stream", "grp", "entry_id")
    got = [r.entry_id for r in J.orphaned_entries(claims, acks).orderBy("entry_id").collect()]
    assert got == list(range(2, 400, 4))


def test_chain(spark):
    cases = [(None, None, True, ("generic", None, True)), ("u", None, True, ("generic", None, True)), ("r", True, True, ("r", None, True)), ("r", False, True, ("generic", "r", True)), ("r", False, False, ("generic", "r", False))]
    jobs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "job_id int, requested string")
    tried = spark.createDataFrame([(i, c[0], c[1], "p") for i, c in enumerate(cases) if c[1] is not None], "job_id int, strategy string, ok boolean, page string")
    plain = spark.createDataFrame([(i, c[2], "g") for i, c in enumerate(cases)], "job_id int, ok boolean, page string")
    got = J.extractor_chain(jobs, tried, plain).orderBy("job_id").collect()
    assert [(r.strategy, r.fallback_from, r.ok) for r in got] == [c[3] for c in cases]


def test_lookup(spark):
    jobs = spark.createDataFrame([("j1", "completed", "me", 1, 1, 100), ("j2", "running", "you", 1, 0, 100), ("j3", "running", "me", 1, 0, 10)], "job_id string, status string, owner string, pages_total int, pages_completed int, expires_at int")
    asked = spark.createDataFrame([("j1", "me", 50), ("j2", "me", 50), ("j3", "me", 50), ("no", "me", 50)], "job_id string, caller string, at int")
    got = {r.job_id: (r.http_code, r.status, r.error) for r in J.lookup_jobs(asked, jobs, "at").collect()}
    missing = (404, None, "job not found")
    assert got == {"j1": (200, "completed", None), "j2": missing, "j3": missing, "no": missing}
    assert "owner" not in J.lookup_jobs(asked, jobs, "at").columns


def test_health(spark):
    entries = spark.createDataFrame([("scrape_jobs",)] * 3, "stream string")
    consumers = spark.createDataFrame([("scrape_jobs", "g", "c1", 5), ("scrape_jobs", "h", "c1", 3)], "stream string, grp string, consumer string, idle_ms long")
    pending = spark.createDataFrame([("scrape_jobs", "g", "1-0", 10), ("scrape_jobs", "g", "2-0", 99), ("scrape_jobs", "h", "3-0", 20)], "stream string, grp string, entry_id string, idle_ms long")
    h = M.queue_health(entries, consumers, pending)
    rows = {r.stream: tuple(r)[2:] for r in h.collect()}
    assert rows == {"scrape_jobs": (3, 2, 20, 3), "browser_jobs": (0, 0, None, None), "stealth_jobs": (0, 0, None, None), "crawl_jobs": (0, 0, None, None)}
    assert M.overall_status(h).first().status == "healthy"
    assert M.overall_status(h.filter("tier <> 'fast'")).first().status == "degraded"
    assert M.overall_status(h, connected=False).first().status == "unhealthy"


def test_usage(spark):
    plans = spark.createDataFrame([], "owner string, " + A.PLAN_SCHEMA)
    usage = spark.createDataFrame([("o", "2024-01-05 00:00:00", 400, 10, True), ("o", "2024-01-31 23:00:00", 200, 1 << 31, False), ("o", "2024-02-01 00:00:00", 1, 1, True)], "owner string, ts string, credits long, bytes long, success boolean").withColumn("ts", F.to_timestamp("ts"))
    got = A.usage_rollup(usage, plans).orderBy("month").collect()
    assert [(r.credits, r.requests, r.succeeded, r.over_credits, r.over_bandwidth) for r in got] == [(600, 2, 1, True, True), (1, 1, 1, False, False)]


def test_shipped_cap_limits_rows_where_they_are_read(spark, tmp_path):
    path = str(tmp_path / "entries")
    spark.range(40_000).selectExpr("concat(id, '-0') AS entry_id", "'s' AS stream", "timestamp_seconds(id) AS enqueued_at").write.parquet(path)
    kept = J.newest_per_stream(spark.read.parquet(path))
    assert kept.count() == J.STREAM_CAP
    plan = kept._jdf.queryExecution().executedPlan().toString()
    before_exchange = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "BroadcastHashJoin" in before_exchange and ">= _limit" in before_exchange


def test_repeated_rows_count_once(spark):
    jobs = spark.createDataFrame([("j", "r")], "job_id string, requested string")
    tried = spark.createDataFrame([], "job_id string, strategy string, ok boolean, page string")
    plain = spark.createDataFrame([("j", False, "x"), ("j", True, "y")], "job_id string, ok boolean, page string")
    assert [(r.ok, r.page) for r in J.extractor_chain(jobs, tried, plain).collect()] == [(True, "y")]


def test_entries_of_one_instant_are_selected_by_digits(spark):
    """Half a million entries of one instant and one stream: no more than twice the cap is ranked."""
    rows = spark.range(500_000).selectExpr("concat(id * 7919 % 500000 + 1700000000000, '-', id % 3) AS entry_id", "timestamp_seconds(1700000000) AS enqueued_at", "if(id % 10 < 9, 'hot', 'calm') AS stream")
    rows = rows.union(spark.createDataFrame([("x", None, "odd"), ("5", None, "odd"), ("7-1", None, None), ("7-2", None, None), ("6-9", None, None)], "entry_id string, enqueued_at timestamp, stream string"))
    recent = J._recent_entries(rows, 100, "stream", "enqueued_at", "entry_id").groupBy("stream").count().collect()
    assert all(r["count"] <= 200 for r in recent) and len(recent) == 4
    got = {(r.stream, r.entry_id) for r in J.newest_per_stream(rows, 100).collect()}
    want = set()
    for stream, last in (("hot", lambda i: i % 10 < 9), ("calm", lambda i: i % 10 == 9)):
        ids = sorted(((i * 7919 % 500_000 + 1_700_000_000_000, i % 3) for i in range(500_000) if last(i)), reverse=True)[:100]
        want |= {(stream, f"{a}-{b}") for a, b in ids}
    assert got == want | {("odd", "x"), ("odd", "5"), (None, "7-1"), (None, "7-2"), (None, "6-9")}
    two = {r.entry_id for r in J.newest_per_stream(rows.filter("stream IS NULL"), 2).collect()}
    assert two == {"7-1", "7-2"}
