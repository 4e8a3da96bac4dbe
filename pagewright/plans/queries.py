"""One query per operator family over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as S

from pagewright.functions import urls as U
from pagewright.functions.addresses import is_private_address
from pagewright.functions.sql import fn as F
from pagewright.operators import admission, chunks, crawl as crawls, domains, health, jobs, markdown, pages as P, ranges, routing, safety, scrape
from pagewright.operators.rows import explode_array
from pagewright.operators.token_store import TokenStore
from pagewright.plans import inputs as I
from pagewright.session import shared_folder
from pagewright.sources.queues import read_queue
from pagewright.sources.snapshot import BODY_CAP, fetch_outcomes, read_pages, read_table
from pagewright.streaming.consumer import acknowledged, consume_queue, stored_results
from pagewright.streaming.status import expire_status, lookup_status, maintain_status
from pagewright.streaming.throttle import throttle_log
from pagewright.streaming.token_bucket import limit_requests

SECRET = "0123456789abcdef0123456789abcdef"


# ---- URLs and routing --------------------------------------------------------------------------


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    df = I.derive(spark, folder, I.with_stored(I.WRITTEN), "pages")
    parts = df.select("page_id", U.url_parts(F.col("url")).alias("p").col)
    return parts.select("page_id", "p.ok", *[S.when(S.col("p.ok"), S.col(f"p.{c}")).alias(c) for c in ("scheme", "userinfo", "host", "port", "path", "query", "fragment")])


def url_parts_lenient(spark, folder):
    df = I.derive(spark, folder, I.with_stored(I.SKIPPABLE), "pages")
    return df.select("page_id", U.url_parts(F.col("url"), U.ROUTER).alias("p").col).select(
        "page_id", *[f"p.{c}" for c in ("scheme", "host", "path", "query", "fragment")]
    )


def url_normalize(spark, folder):
    df = I.derive(spark, folder, I.with_stored(I.WRITTEN), "pages")
    return df.select("page_id", U.normalize_url(F.col("url")).alias("url").col)


def url_normalize_dedup(spark, folder):
    df = read_table(spark, folder, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url").col)
    return df.groupBy("url").agg(S.min("page_id").alias("first_page"), S.count("*").alias("copies"))


def url_redact(spark, folder):
    df = I.derive(spark, folder, I.with_stored(I.WRITTEN), "pages")
    return df.select(
        "page_id", U.redact_url(F.col("url")).alias("gateway_url").col, U.redact_url(F.col("url"), U.BROWSER).alias("browser_url").col
    )


def url_skip(spark, folder):
    df = I.derive(spark, folder, I.with_stored(I.SKIPPABLE), "pages")
    return df.select("page_id", U.skip_decision(F.col("url")).alias("s").col).select("page_id", "s.skip", "s.reason")


def _routes(spark, folder, dialect=U.GATEWAY):
    df = I.derive(spark, folder, I.with_stored(I.ROUTED, extra=f", {I.CONTENT_TYPE} AS content_type"), "pages")
    headers = F.map("Content-Type", F.col("content_type")) if dialect == U.ROUTER else None
    return df.select("page_id", routing.classify_url(F.col("url"), dialect, headers).alias("r").col).select("page_id", "r.*")


def url_routing(spark, folder):
    return _routes(spark, folder)


def url_routing_lenient(spark, folder):
    return _routes(spark, folder, U.ROUTER).drop("strategy")


def route_distribution(spark, folder):
    return routing.route_distribution(_routes(spark, folder)).withColumn("avg_confidence", S.round("avg_confidence", 6))


def route_log(spark, folder):
    df = I.derive(spark, folder, I.with_stored(I.ROUTED, "job_id"), "pages")
    return routing.route_log(df, "job_id", "url")


def response_routing(spark, folder):
    """Every stored body and, under other ids, made ones that reach the rules."""
    header = "CASE page_id % 23 WHEN 2 THEN 'CF-Mitigated' WHEN 6 THEN 'X-Px-Token' ELSE 'Server' END AS header"
    sql = f"""SELECT page_id, {I.STATUS} AS status, {I.CONTENT_TYPE} AS content_type, {header}, html AS body FROM pages UNION ALL
     SELECT page_id + 1000000000 AS page_id, {I.STATUS} AS status, {I.CONTENT_TYPE} AS content_type, {header},
      CASE page_id % 7 WHEN 1 THEN html || 'Checking YOUR browser' WHEN 2 THEN '<div id="root"></div>' WHEN 3 THEN '<script a></script><SCRIPT b></SCRIPT>'
        WHEN 4 THEN html || '<div id="app">' WHEN 5 THEN '<p>' || CAST(page_id AS STRING) || '</p>' WHEN 6 THEN repeat(html, 20) || 'Access denied' ELSE html END AS body FROM pages"""
    df = I.derive(spark, folder, sql, "pages")
    headers = F.map("Content-Type", F.col("content_type"), F.col("header"), "1")
    return df.select("page_id", routing.classify_response(F.col("status"), headers, F.col("body")).alias("r").col).select(
        "page_id", "r.tier", "r.reason", "r.confidence"
    )


# ---- addresses ---------------------------------------------------------------------------------


def private_ip(spark, folder):
    docs = read_table(spark, folder, "documents")
    written = F.regexp_extract_all(F.col("text"), r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0)
    made = S.expr(
        "array(concat_ws('.', doc_id % 256, doc_id % 7 * 16, 3, 4), concat_ws('.', 172, doc_id % 40, 0, 1), concat_ws('.', 100, 60 + doc_id % 80, 0, 1), concat_ws('.', 169, 250 + doc_id % 6, 1, 300))"
    )
    ips = explode_array(docs, ["doc_id"], S.concat(written.col, made), "pos", "ip").select("doc_id", "ip").distinct()
    return ips.select("doc_id", "ip", *[is_private_address(F.col("ip"), d).alias(d).col for d in ("gateway", "fast", "browser", "strict")])


def private_ip6(spark, folder):
    ips = I.derive(spark, folder, I.IP6, "documents")
    return ips.select("doc_id", "ip", *[is_private_address(F.col("ip"), d).alias(d).col for d in ("gateway", "fast", "browser", "strict")])


def ip_ranges(spark, folder):
    """Each address with the longest of the ranges that hold it."""
    found = ranges.match_ranges(I.derive(spark, folder, I.RANGE_ADDRESSES, "documents"), "ip", I.derive(spark, folder, I.RANGE_TABLE, "documents"))
    return found.select("doc_id", "kind", "ip", "range.cidr", S.col("range.doc_id").alias("range_doc"))


def host_domains(spark, folder):
    """Each host with the longest name of each list that holds for it, over the shipped lists and a table that grows."""
    names = domains.default_domains(spark).unionByName(I.derive(spark, folder, I.NAMED, "pages"))
    return domains.match_domains(I.derive(spark, folder, I.HOSTS, "pages"), "host", names)


def _dns(spark, folder):
    return I.derive(spark, folder, I.DNS, "pages")


def url_safety(spark, folder):
    sql = I.with_stored("CASE page_id % 9 WHEN 1 THEN 'ftp://h/' || url WHEN 2 THEN 'http://10.0.0.1/' WHEN 3 THEN 'https:///x' WHEN 4 THEN 'http://[::1]/' WHEN 5 THEN 'http://8.8.8.8/' ELSE url END")
    df = I.derive(spark, folder, sql, "pages")
    return safety.validate_urls(df, "url", _dns(spark, folder)).select("page_id", "url_ok", "url_error", "pinned_ip")


def url_safety_browser(spark, folder):
    ip = ", CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '100.64.0.' || CAST(page_id % 250 AS STRING) WHEN 2 THEN 'not-an-ip' ELSE '93.184.216.34' END AS ip"
    sql = I.with_stored("CASE page_id % 6 WHEN 1 THEN 'file:///etc' WHEN 2 THEN 'http://127.0.0.1/' WHEN 3 THEN 'not-a-url' ELSE url END", extra=ip)
    df = I.derive(spark, folder, sql, "pages")
    return df.select("page_id", safety.browser_verdict(F.col("url"), F.col("ip")).alias("error").col)


def redirect_safety(spark, folder):
    hops = I.derive(spark, folder, "SELECT page_id DIV 7 AS chain_id, page_id % 7 + 1 AS hop, url FROM pages", "pages")
    return safety.redirect_verdicts(hops, _dns(spark, folder))


# ---- pages -------------------------------------------------------------------------------------


def _fetched(spark, folder, cap=BODY_CAP):
    snapshot = I.derive(spark, folder, f"SELECT page_id, url, {I.STATUS} AS status, {I.CONTENT_TYPE} AS content_type, html FROM pages", "pages")
    asked = I.derive(spark, folder, "SELECT page_id AS request_id, CASE page_id % 6 WHEN 1 THEN url || '/' WHEN 2 THEN url || '#x' WHEN 3 THEN 'http://missing.example/' ELSE url END AS url FROM pages", "pages")
    return fetch_outcomes(asked, "url", snapshot, cap=cap).select("request_id", "url", "status", "error", S.length("content").alias("content_chars"))


def fetch_outcome(spark, folder):
    return _fetched(spark, folder)


def fetch_outcome_truncated(spark, folder):
    """The same at a cap that cuts most bodies, some of them inside a character."""
    return _fetched(spark, folder, I.CUT_CAP)


def page_tokens(spark, folder):
    t = P.tokens(read_pages(spark, folder))
    return t.groupBy("page_id", "kind").agg(S.count("*").alias("n"), S.max("pos").alias("last_pos"))


def page_token_text(spark, folder):
    """Tags, attributes and texts of all tokens, in order, as one checksum per page, kind and tag."""
    t = P.tokens(read_pages(spark, folder)).withColumn("tag", S.coalesce("tag", S.lit("")))
    attrs = S.array_join(S.transform("attrs", lambda a: S.concat(a["name"], S.lit("="), a["value"])), ";")
    said = S.concat(S.coalesce(attrs, S.lit("")), S.lit(">"), S.coalesce("text", S.lit("")))
    rows = t.groupBy("page_id", "kind", "tag").agg(S.sort_array(S.collect_list(S.struct("pos", said.alias("said")))).alias("r"))
    return rows.select("page_id", "kind", "tag", S.size("r").alias("n"), S.md5(S.array_join(S.transform("r", lambda x: x["said"]), "|")).alias("said"))


def token_store(spark, folder):
    """Title, links, metadata and text of every page from tokens that are parsed and stored once, and its lists as intervals."""
    store = TokenStore.make(read_pages(spark, folder))
    links = store.links().groupBy("page_id").agg(S.count("*").alias("n_links"), S.md5(S.array_join(S.transform(S.array_sort(S.collect_list(S.struct("pos", "link"))), lambda x: x["link"]), " ")).alias("links"))
    lists = store.elements("ul", "li").groupBy("page_id").agg(S.count("*").alias("n_lists"), S.sum(S.col("close") - S.col("open")).alias("list_tokens"))
    text = store.text().select("page_id", S.md5("text").alias("text"))
    crawl_title = store.titles().withColumnRenamed("title", "crawl_title")
    out = store.metadata().select("page_id", "title", "language").join(crawl_title, "page_id").join(text, "page_id")
    return out.join(links, "page_id", "left").join(lists, "page_id", "left").na.fill(0, ["n_links", "n_lists", "list_tokens"])


def page_title(spark, folder):
    return P.page_titles(read_pages(spark, folder))


def page_metadata(spark, folder):
    return P.page_metadata(read_pages(spark, folder))


def page_metadata_browser(spark, folder):
    return P.page_metadata(read_pages(spark, folder), dialect="browser")


def page_metadata_heads(spark, folder):
    return P.page_metadata(I.derive(spark, folder, I.HEADS, "pages"))


def page_metadata_heads_browser(spark, folder):
    return P.page_metadata(I.derive(spark, folder, I.HEADS, "pages"), dialect="browser")


def page_links_schemes(spark, folder):
    links = P.page_links(I.derive(spark, folder, I.LINKED, "pages"), keep=("url",))
    host = U.url_parts(F.col("url")).col["host"]
    none = S.array().cast("array<string>")
    rules = links.withColumns({"seed_host": host, "include": none, "exclude": S.array(S.lit("/drop"))})
    keep = P.keep_link(F.col("link"), F.col("seed_host"), F.col("include"), F.col("exclude"))
    return rules.select("page_id", "pos", "link", keep.alias("kept").col)


def page_links(spark, folder):
    return P.page_links(read_pages(spark, folder))


def page_links_filtered(spark, folder):
    links = P.page_links(read_pages(spark, folder), keep=("url",))
    seeded = links.withColumn("seed_host", U.url_parts(F.col("url")).col["host"]).withColumns(
        {
            "include": S.when(S.col("page_id") % 2 == 0, S.array(S.lit("/t"), S.lit("/d"))).otherwise(S.array().cast("array<string>")),
            "exclude": S.when(S.col("page_id") % 3 == 0, S.array(S.lit("on"))).otherwise(S.array().cast("array<string>")),
        }
    )
    keep = P.keep_link(F.col("link"), F.col("seed_host"), F.col("include"), F.col("exclude"))
    return seeded.filter(keep.col).select("page_id", "pos", "link")


def page_text(spark, folder):
    return P.page_text(read_pages(spark, folder))


def page_markdown(spark, folder):
    return markdown.page_markdown(read_pages(spark, folder))


def page_markdown_ai(spark, folder):
    return markdown.page_markdown(read_pages(spark, folder), dialect="ai")


def page_markdown_browser(spark, folder):
    return markdown.page_markdown(read_pages(spark, folder), dialect="browser")


def _elements(spark, folder, dialect):
    pages = I.derive(spark, folder, I.ELEMENT_PAGES, "documents")
    return markdown.page_markdown(pages, "doc_id", dialect=dialect)


def markdown_elements(spark, folder):
    return _elements(spark, folder, "fast")


def markdown_elements_ai(spark, folder):
    return _elements(spark, folder, "ai")


def markdown_elements_browser(spark, folder):
    return _elements(spark, folder, "browser")


def output_format(spark, folder):
    sql = "SELECT page_id, html, 'md' || CAST(page_id AS STRING) AS markdown, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'text' WHEN 2 THEN 'pdf' ELSE 'markdown' END AS format FROM pages"
    df = I.derive(spark, folder, sql, "pages")
    out = P.output_columns(F.col("format"), F.col("html"), F.col("markdown"))
    return df.select("page_id", P.is_valid_format(F.col("format")).alias("valid").col, out.alias("o").col).select(
        "page_id", "valid", "o.content", "o.markdown"
    )


# ---- crawls ------------------------------------------------------------------------------------


def _crawl_inputs(spark, folder):
    snapshot = I.derive(spark, folder, I.CRAWL_PAGES, "pages")
    none = S.array().cast("array<string>")
    asked = I.derive(spark, folder, I.CRAWL_JOBS, "pages").select(
        S.concat(S.lit("job-"), S.col("site")).alias("job_id"),
        "url",
        "max_pages",
        "max_depth",
        S.when(S.col("site") % 3 == 1, S.array(S.lit("/n"), S.lit("never"))).otherwise(none).alias("include_patterns"),
        S.when(S.col("site") % 4 == 2, S.array(S.lit("/n5"))).otherwise(none).alias("exclude_patterns"),
    )
    return asked, snapshot


def crawl_bfs(spark, folder):
    asked, snapshot = _crawl_inputs(spark, folder)
    return crawls.crawl(asked, snapshot).select("job_id", "rank", "depth", "url", "status_code", "title", "bytes", "error")


def crawl_budget(spark, folder):
    asked, snapshot = _crawl_inputs(spark, folder)
    return crawls.crawl(asked, snapshot, byte_limit=9_000).select("job_id", "rank", "depth", "bytes", "error")


def _with_bad_seed(asked):
    bad = asked.limit(1).withColumns({"job_id": S.lit("job-bad"), "url": S.lit("http://example.com/%zz")})
    return asked.unionByName(bad)


def crawl_summary(spark, folder):
    asked, snapshot = _crawl_inputs(spark, folder)
    asked = _with_bad_seed(asked)
    return crawls.crawl_summary(asked, crawls.crawl(asked, snapshot))


def crawl_results(spark, folder):
    """Results of each crawl with the stored pages as content, in page order, as one checksum a crawl."""
    asked, snapshot = _crawl_inputs(spark, folder)
    made = crawls.crawl_results(crawls.crawl(asked, snapshot), snapshot)
    said = S.transform("results", lambda r: S.concat_ws("|", r["data"]["metadata"]["title"], r["data"]["metadata"]["status_code"].cast("string"), S.md5(r["data"]["content"])))
    return made.select("job_id", S.size("results").cast("long").alias("n"), S.md5(S.array_join(said, ";")).alias("said"))


def crawl_status(spark, folder):
    asked, snapshot = _crawl_inputs(spark, folder)
    asked = _with_bad_seed(asked)
    return crawls.crawl_status_events(asked, crawls.crawl(asked, snapshot))


# ---- chunks and extraction ---------------------------------------------------------------------


def _markdown_docs(spark, folder):
    return I.derive(spark, folder, f"SELECT doc_id, {I.MARKDOWN} AS md FROM documents", "documents")


def chunk_headings(spark, folder):
    sections = explode_array(_markdown_docs(spark, folder), ["doc_id"], chunks.sections(F.col("md")).col, "section", "s")
    return sections.select("doc_id", "section", "s.heading", "s.body")


def chunk_pack(spark, folder):
    return chunks.chunk_documents(_markdown_docs(spark, folder), "doc_id", "md", 128)


def prompt_table(spark, folder):
    sql = """SELECT doc_id, '<h1>Doc ' || CAST(doc_id AS STRING) || '</h1><script>x</script><p>' ||
      replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p>' AS html,
      '{"type": "object", "id": ' || CAST(doc_id AS STRING) || '}' AS schema FROM documents"""
    return chunks.extraction_prompts(I.derive(spark, folder, sql, "documents"), "doc_id", "html", "schema", "any-model").select("doc_id", "prompt")


def prompt_request(spark, folder):
    sql = """SELECT doc_id, '<h1>Doc ' || CAST(doc_id AS STRING) || '</h1><p>' || replace(regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0), '<', '') || '</p>' AS html,
      '{"type": "object", "id": ' || CAST(doc_id AS STRING) || '}' AS schema FROM documents"""
    return chunks.extraction_prompts(I.derive(spark, folder, sql, "documents"), "doc_id", "html", "schema", "any-model", "Answer in \"JSON\".\nNothing else").select("doc_id", "request")


def response_parse(spark, folder):
    sql = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"choices": []}' WHEN 1 THEN '{"choices": [{"message": {"content": "oops ' || event_type || '"}}]}'
      WHEN 2 THEN 'gateway timeout' ELSE '{"choices": [{"message": {"content": "' || replace(props, '"', '\\\\"') || '"}}]}' END AS body FROM events"""
    df = I.derive(spark, folder, sql, "events")
    parsed = chunks.typed_results(chunks.parse_responses(df, "event_id", "body"), "k bigint")
    return parsed.select("event_id", "extracted", "error", S.col("data.k").alias("k"))


# ---- governance --------------------------------------------------------------------------------


def _plans(spark, folder):
    plans = I.derive(spark, folder, I.PLANS, "customer")
    tiers = S.when(S.col("tiers") == "", S.array().cast("array<string>")).otherwise(S.split("tiers", ","))
    flags = {c: S.lit(False) for c in ("can_webhook", "has_sla", "can_overage")}
    return plans.withColumn("allowed_tiers", tiers).withColumns(flags).drop("tiers")


def _requests(spark, folder):
    return admission.with_plan(I.derive(spark, folder, I.REQUESTS, "orders"), "owner", _plans(spark, folder))


def admission_verdicts(spark, folder):
    dns = spark.sql(I.REQUEST_DNS)
    admitted = admission.admit(_requests(spark, folder), dns)
    return admitted.select("request_id", "kind", "http_code", "error", "tier", "strategy", "stream", "pinned_ip", S.col("plan.name").alias("plan_name"))


def crawl_caps(spark, folder):
    capped = admission.crawl_caps(_requests(spark, folder))
    ttl = admission.result_ttl_seconds(S.col("plan.result_retention_hours"))
    return capped.select(
        "request_id", "max_pages", "max_depth", "max_timeout", "format", ttl.alias("plan_ttl"), admission.effective_ttl_seconds(ttl).alias("ttl"),
        admission.effective_rate().cast("long").alias("rate"),
    )


def request_payloads(spark, folder):
    rows = _requests(spark, folder).withColumns({"wait_for": S.lit(None).cast("string"), "timeout": S.col("max_timeout"), "wait": S.col("request_id") % 2 == 0})
    patterns = rows.withColumns({"include_patterns": S.array(S.lit("/docs/")), "exclude_patterns": S.array().cast("array<string>")})
    return patterns.select(
        "request_id", jobs.scrape_payload().alias("scrape_payload"), jobs.crawl_payload(admission.result_ttl_seconds(S.col("plan.result_retention_hours"))).alias("crawl_payload")
    )


def owner_hash(spark, folder):
    c = read_table(spark, folder, "customer")
    key = S.when(S.col("c_custkey") % 10 == 0, S.lit("anonymous")).when(S.col("c_custkey") % 10 == 1, S.lit("")).otherwise(S.col("c_name"))
    hashed = c.select("c_custkey", admission.owner_hash(key).alias("hash"))
    ip = S.concat(S.lit("10.0.0."), S.col("c_custkey"))
    return hashed.select("c_custkey", admission.caller_owner(S.col("hash")).alias("owner"), admission.rate_key(S.col("hash"), ip).alias("rate_key"))


def access_log(spark, folder):
    sql = """SELECT event_id, 'POST' AS method, '/v1/' || event_type AS path, 200 + event_id % 3 AS status, value AS duration,
      CASE event_id % 4 WHEN 0 THEN '192.168.' || CAST(event_id % 256 AS STRING) || '.42' WHEN 1 THEN '2001:db8::' || CAST(event_id % 99 AS STRING) WHEN 2 THEN 'weird' ELSE '1.2.3.4.5' END AS ip,
      CASE event_id % 3 WHEN 0 THEN 'anonymous' WHEN 1 THEN '' ELSE 'key-' || CAST(user_id AS STRING) END AS key FROM events"""
    return admission.access_log(I.derive(spark, folder, sql, "events"), "method", "path", "status", "duration", "ip", "key")


def key_check(spark, folder):
    known = read_table(spark, folder, "customer").filter("c_acctbal > 0").select(S.sha2("c_name", 256).alias("key_hash"))
    asked = I.derive(spark, folder, "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END AS api_key FROM orders", "orders")
    return admission.check_keys(asked, "api_key", known).select("request_id", "key_error")


SIGNED = """SELECT o_orderkey AS request_id, CASE o_orderkey % 10 WHEN 9 THEN '' WHEN 4 THEN upper(sha256_hex) ELSE sha256_hex END AS owner,
  CASE o_orderkey % 10 WHEN 9 THEN '' WHEN 5 THEN '***' WHEN 6 THEN 'eyJuYW1lIjoxfQ==' ELSE 'eyJuYW1lIjoicHJvIiwibWF4X2NyYXdsX3BhZ2VzIjo1MH0=' END AS plan_b64,
  CASE o_orderkey % 10 WHEN 9 THEN '' WHEN 2 THEN 'soon' WHEN 3 THEN CAST(1700000000 - o_orderkey AS STRING) ELSE CAST(1700000000 + o_orderkey % 30 AS STRING) END AS ts,
  'POST' AS method, '/v1/scrape?x=' || CAST(o_orderkey AS STRING) AS uri FROM (SELECT o_orderkey, {hash} AS sha256_hex FROM orders) AS o"""


def signed_plan(spark, folder):
    inner = SIGNED.replace("{hash}", "sha2(CAST(o_custkey AS STRING), 256)")
    rows = I.derive(spark, folder, inner, "orders")
    sig = admission.sign_plan(SECRET, *[S.col(c) for c in ("owner", "plan_b64", "ts", "method", "uri")])
    kind = S.col("request_id") % 10
    signed = rows.withColumn("signature", S.when(kind == 9, "").when(kind == 1, S.reverse(sig)).otherwise(sig)).withColumn("now", S.lit(1700000015))
    judged = admission.signed_plan_verdicts(signed, SECRET)
    return judged.select("request_id", "signature", "verdict", S.col("plan.name").alias("plan_name"), S.col("plan.max_crawl_pages").alias("max_crawl_pages"))


def token_bucket(spark, folder):
    events = I.derive(spark, folder, I.SQUEEZED, "events").withColumn("ts", S.timestamp_micros("us"))
    limited = limit_requests(events, "event_type", "ts", "event_id", S.lit(10))
    return limited.select("event_type", "event_id", "allowed", "remaining")


def token_bucket_owners(spark, folder):
    events = I.derive(spark, folder, I.SQUEEZED, "events").withColumn("ts", S.timestamp_micros("us"))
    limited = limit_requests(events, "user_id", "ts", "event_id", S.coalesce(S.col("user_id"), S.lit(4)) % 2 + 1)
    return limited.select("user_id", "event_id", "allowed", "remaining")


def reject_throttle(spark, folder):
    events = I.derive(spark, folder, I.SQUEEZED, "events").withColumn("ts", S.timestamp_micros("us"))
    return throttle_log(events, "event_type", "ts", "event_id").select("event_type", "event_id", "emitted", "suppressed")


def usage_rollup(spark, folder):
    usage = read_table(spark, folder, "orders").select(
        S.col("o_custkey").alias("owner"),
        S.col("o_orderdate").alias("ts"),
        S.floor(S.col("o_totalprice") / 100).cast("long").alias("credits"),
        (S.col("o_orderkey") * 5000).alias("bytes"),
        (S.col("o_orderstatus") == "F").alias("success"),
    )
    return admission.usage_rollup(usage, _plans(spark, folder))


# ---- jobs and queues ---------------------------------------------------------------------------


def queue_entries(spark, folder):
    sql = f"""SELECT CAST(event_id AS STRING) AS entry_id, event_id % 7 AS k, {I.STREAM_OF} AS stream, 'job-' || CAST(user_id AS STRING) AS job,
      'http://h/' || CAST(event_id AS STRING) AS u FROM events"""
    df = I.derive(spark, folder, sql, "events")
    fields = S.map_filter(
        S.create_map(S.lit("url"), S.when(S.col("k") == 1, S.lit("")).otherwise(S.col("u")), S.lit("job_id"), S.col("job"), S.lit("strategy"), S.lit("")),
        lambda key, _: ~(((key == "url") & (S.col("k") == 2)) | ((key == "job_id") & (S.col("k") == 3))),
    )
    entries = df.select("entry_id", "stream", fields.alias("fields"))
    parts = []
    for dialect in ("fast", "browser"):
        good, bad = jobs.split_entries(entries, dialect)
        parts.append(good.select(S.lit(dialect).alias("dialect"), "entry_id", "job_id", "url", S.lit(True).alias("usable")))
        none = S.lit(None).cast("string")
        parts.append(bad.select(S.lit(dialect).alias("dialect"), "entry_id", none.alias("job_id"), none.alias("url"), S.lit(False).alias("usable")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def queue_trim(spark, folder):
    entries = I.derive(spark, folder, f"SELECT {I.ENTRY_ID} AS entry_id, ts AS enqueued_at, {I.STREAM_OF} AS stream FROM events", "events")
    return jobs.newest_per_stream(entries, 50).select("stream", "entry_id")


def queue_trim_shipped(spark, folder):
    """At the shipped cap, on a stream that is longer: all events in one, ten entries to a millisecond."""
    entries = I.derive(spark, folder, f"SELECT {I.ENTRY_ID} AS entry_id, ts AS enqueued_at, CASE WHEN event_id % 50 = 0 THEN 'crawl_jobs' ELSE 'scrape_jobs' END AS stream FROM events", "events")
    return jobs.newest_per_stream(entries).select("stream", "entry_id")


CLAIMS = f"SELECT event_id, {I.ENTRY_ID} AS entry_id, {I.STREAM_OF} AS stream, 'g' || CAST(user_id % 3 AS STRING) AS grp, 'c' || CAST(user_id % 5 AS STRING) AS consumer, event_id * 7919 % 120000 AS idle_ms FROM events"


def orphans(spark, folder):
    claims = I.derive(spark, folder, CLAIMS, "events")
    acks = claims.filter("event_id % 4 = 0").select("stream", "grp", "entry_id")
    return jobs.orphaned_entries(claims, acks).select("stream", "grp", "entry_id", "idle_ms")


def job_latest_status(spark, folder):
    return jobs.latest_status(I.derive(spark, folder, I.STATUS_EVENTS, "events"))


def job_lookup(spark, folder):
    latest = job_latest_status(spark, folder)
    stored = latest.select(
        "job_id", "status", S.concat(S.lit("owner-"), S.col("job_id") % 5).alias("owner"), S.lit(40).alias("pages_total"), "pages_completed",
        (S.col("seq") + 5000).alias("expires_at"),
    )
    asked = I.derive(spark, folder, "SELECT o_orderkey AS lookup_id, o_custkey AS job_id, 'owner-' || CAST(o_orderkey % 5 AS STRING) AS caller, 9000 AS asked_at FROM orders", "orders")
    return jobs.lookup_jobs(asked, stored, "asked_at").select("lookup_id", "http_code", "status", "pages_total", "pages_completed", "error")


def extractor_chain(spark, folder):
    sql = """SELECT page_id AS job_id, CASE page_id % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'github_repo' WHEN 2 THEN 'hn_thread' ELSE 'unknown' END AS requested,
      page_id % 3 <> 0 AS extractor_ok, page_id % 5 <> 0 AS generic_ok, length(html) AS chars FROM pages"""
    df = I.derive(spark, folder, sql, "pages")
    registered = df.filter(S.col("requested").isin("github_repo", "hn_thread")).select(
        "job_id", S.col("requested").alias("strategy"), S.col("extractor_ok").alias("ok"), S.struct(S.lit("s").alias("via"), "chars").alias("page")
    )
    generic = df.select("job_id", S.col("generic_ok").alias("ok"), S.struct(S.lit("g").alias("via"), "chars").alias("page"))
    chain = jobs.extractor_chain(df.select("job_id", "requested"), registered, generic)
    return chain.select("job_id", "strategy", "fallback_from", "ok", S.col("page.via").alias("via"), S.col("page.chars").alias("chars"))


def job_results(spark, folder):
    rows = P.page_metadata(read_pages(spark, folder), keep=("url",)).withColumn("ok", S.col("page_id") % 4 != 0)
    data = jobs.result_data(
        S.col("url"), S.lit(None).cast("string"), S.regexp_replace("title", r'["\\]', ""), S.col("description"), S.col("language"), S.lit(200),
        S.lit("generic"), S.when(S.col("page_id") % 3 == 0, S.lit("hn_thread")),
    )
    return rows.select("page_id", jobs.job_status_json(S.concat(S.lit("job-"), S.col("page_id")), S.col("ok"), data).alias("status_json"))


def _scrapes(spark, folder, sql, body_cap):
    asked = I.derive(spark, folder, sql, "pages")
    requests = admission.with_plan(asked, "owner", _plans(spark, folder))
    snapshot = I.derive(spark, folder, f"SELECT page_id, url, {I.STATUS} AS status, {I.CONTENT_TYPE} AS content_type, html FROM pages", "pages")
    dns = I.derive(spark, folder, I.SCRAPE_DNS, "pages")
    return scrape.scrape_results(requests, snapshot, dns, body_cap=body_cap)


def scrape_results(spark, folder):
    """Every failing rule, at a small cap."""
    return _scrapes(spark, folder, I.SCRAPES, I.SCRAPE_CAP)


def scrape_results_stored(spark, folder):
    """Every stored page at its stored URL, at the shipped cap."""
    return _scrapes(spark, folder, I.STORED_SCRAPES, BODY_CAP)


def status_expiry(spark, folder):
    rows = I.derive(spark, folder, f"SELECT * FROM ({I.STATUS_EVENTS}) AS s", "events")
    kept = jobs.latest_status(jobs.status_writes(rows, "seq", admission.result_ttl_seconds(S.col("job_id") % 5 * 6)))
    return kept.select("job_id", "seq", "status", "expires_at", "owner_expires_at")


def consumed_results(spark, folder):
    """Jobs consumed from a stored queue, results before acknowledgements, and which entries are acknowledged."""
    entries = I.derive(spark, folder, I.QUEUED, "events").selectExpr("entry_id", "ts AS enqueued_at", "stream", "map_filter(map('url', url, 'job_id', job), (k, v) -> v IS NOT NULL) AS fields")
    place = shared_folder(spark)
    jobs.write_queue(entries, f"{place}/queue")
    work = lambda usable: usable.select("job_id", "url", S.concat(S.lit("page of "), "url").alias("page"))
    for name in ("scrape_jobs", "browser_jobs"):  # one after the other, as a worker of each stream would
        consume_queue(read_queue(spark, f"{place}/queue", name, 64), work, f"{place}/{name}", f"{place}/{name}-offsets").awaitTermination()
    found = [
        stored_results(spark, f"{place}/{name}", "job_id string, url string, page string").select(S.lit(name).alias("stream"), "job_id", "page") for name in ("scrape_jobs", "browser_jobs")
    ]
    acks = [acknowledged(spark, f"{place}/{name}").select(S.lit(f"{name} acknowledged").alias("stream"), S.col("entry_id").alias("job_id"), S.lit(None).cast("string").alias("page")) for name in ("scrape_jobs", "browser_jobs")]
    return reduce(DataFrame.unionByName, found + acks)


def status_store(spark, folder):
    """Status rows kept by a stream, swept of what has expired, and looked up on both sides of their instants."""
    rows = I.derive(spark, folder, I.STATUS_EVENTS, "events")
    kept = rows.selectExpr("CAST(job_id AS STRING) AS job_id", "seq", "status", "concat('owner-', job_id % 5) AS owner", "40 AS pages_total", "pages_completed", "seq + job_id % 7 * 1000 AS expires_at")
    place = shared_folder(spark)
    kept.write.parquet(f"{place}/events")
    stream = spark.readStream.schema(kept.schema).parquet(f"{place}/events")
    maintain_status(stream, f"{place}/status", f"{place}/offsets").awaitTermination()
    expire_status(spark, f"{place}/status", S.lit(3000))
    asked = I.derive(spark, folder, "SELECT o_orderkey AS lookup_id, CAST(o_custkey AS STRING) AS job_id, 'owner-' || CAST(o_orderkey % 5 AS STRING) AS caller, o_orderkey % 9000 AS asked_at FROM orders", "orders")
    return lookup_status(asked, f"{place}/status", "asked_at").select("lookup_id", "http_code", "status", "pages_completed", "error")


def _health(spark, folder):
    claims = I.derive(spark, folder, CLAIMS, "events")
    return health.queue_health(claims, claims.filter("stream <> 'stealth_jobs'"), claims.filter("event_id % 4 <> 0"))


def queue_health(spark, folder):
    return _health(spark, folder)


def overall_status(spark, folder):
    return health.overall_status(_health(spark, folder))


def overall_status_cases(spark, folder):
    known = _health(spark, folder)
    cases = {"all": (known, True), "no fast worker": (known.filter("tier <> 'fast'"), True), "no connection": (known, False)}
    rows = [health.overall_status(h, connected).select(S.lit(name).alias("case"), "status") for name, (h, connected) in cases.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {
    f.__name__: f
    for f in (
        token_store, consumed_results, status_store, fetch_outcome_truncated, crawl_results,
        url_parts, url_parts_lenient, url_normalize, url_normalize_dedup, url_redact, url_skip, url_routing, url_routing_lenient,
        route_distribution, route_log, response_routing, private_ip, url_safety, url_safety_browser, redirect_safety, fetch_outcome,
        page_tokens, page_title, page_metadata, page_metadata_browser, page_links, page_links_filtered, page_text, page_markdown,
        page_markdown_ai, page_markdown_browser, markdown_elements, markdown_elements_ai, markdown_elements_browser, output_format, crawl_bfs, crawl_budget, crawl_summary, crawl_status, chunk_headings,
        chunk_pack, prompt_table, response_parse, admission_verdicts, crawl_caps, request_payloads, owner_hash, access_log, key_check,
        signed_plan, token_bucket, token_bucket_owners, reject_throttle, usage_rollup, queue_entries, queue_trim, queue_trim_shipped, orphans,
        job_latest_status, job_lookup, extractor_chain, job_results, scrape_results, scrape_results_stored, status_expiry, queue_health, overall_status,
        overall_status_cases, page_token_text, private_ip6, page_metadata_heads, page_metadata_heads_browser, page_links_schemes, prompt_request, ip_ranges, host_domains,
    )
}
