"""Request governance over request tables, batch or streaming."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions.sql import fn as Q
from pagewright.operators.chunks import schema_error
from pagewright.operators.routing import classify_url, is_tier_allowed, queue_for_tier
from pagewright.operators.safety import validate_urls

ANONYMOUS = "anonymous"
DEFAULT_RATE = 10
MAX_RETENTION_HOURS = 720
DEFAULT_TTL_SECONDS = 3600
WORKER_TTL_SECONDS = 3600
MAX_SKEW_SECONDS = 30

# The plan of an owner without one.
FREE_PLAN = {
    "name": "free",
    "max_credits_per_month": 500,
    "allowed_tiers": ["fast"],
    "can_extract": False,
    "max_rate_per_min": 10,
    "max_concurrency": 2,
    "max_crawl_pages": 10,
    "result_retention_hours": 1,
    "can_webhook": False,
    "has_sla": False,
    "can_overage": False,
    "max_bandwidth_gb": 1,
}
PLAN_SCHEMA = (
    "name string, max_credits_per_month bigint, allowed_tiers array<string>, can_extract boolean, max_rate_per_min bigint, "
    "max_concurrency bigint, max_crawl_pages bigint, result_retention_hours bigint, can_webhook boolean, has_sla boolean, "
    "can_overage boolean, max_bandwidth_gb bigint"
)
_PLAN_TYPES = dict(field.split(" ", 1) for field in PLAN_SCHEMA.split(", "))


# ---- owners and logs ---------------------------------------------------------------------------


def owner_hash(key: Column) -> Column:
    """Lower-case hex SHA-256 of the key; a missing or anonymous key has no hash."""
    return F.when((F.coalesce(key, F.lit("")) != "") & (key != ANONYMOUS), F.sha2(key, 256))


def caller_owner(hash_: Column) -> Column:
    """The owner written on jobs."""
    return F.coalesce(F.nullif(hash_, F.lit("")), F.lit(ANONYMOUS))


def rate_key(hash_: Column, ip: Column) -> Column:
    """G6."""
    return F.coalesce(F.nullif(hash_, F.lit("")), ip)


def anonymize_ip(ip: Column) -> Column:
    """The last part becomes 0."""
    return (
        F.when(F.size(F.split(ip, r"\.")) == 4, F.concat(F.substring_index(ip, ".", 3), F.lit(".0")))
        .when(F.contains(ip, F.lit(":")), F.regexp_replace(ip, r"(?s):[^:]*\z", ":0"))
        .otherwise(F.lit("redacted"))
    )


def access_log(df: DataFrame, method: str, path: str, status: str, duration: str, ip: str, key: str) -> DataFrame:
    """The log projection of a request table; the key is shown as the head of its hash."""
    hash_ = owner_hash(F.col(key))
    shown = (
        F.when(hash_.isNotNull(), F.concat(F.substring(hash_, 1, 8), F.lit("...")))
        .when(F.col(key) == ANONYMOUS, F.lit(ANONYMOUS))
        .otherwise(F.lit("-"))
    )
    return df.select(
        F.col(method).alias("method"),
        F.col(path).alias("path"),
        F.col(status).alias("status"),
        F.col(duration).alias("duration"),
        anonymize_ip(F.col(ip)).alias("ip"),
        shown.alias("key"),
    )


def check_keys(requests: DataFrame, key: str, known_keys: DataFrame) -> DataFrame:
    """Adds key_error: missing, invalid or NULL. ``known_keys`` holds hashes in key_hash."""
    known = known_keys.select("key_hash").distinct().withColumn("_known", F.lit(True))
    hashed = requests.withColumn("key_hash", F.sha2(F.col(key), 256))
    error = F.when(F.coalesce(F.col(key), F.lit("")) == "", F.lit("missing API key")).when(
        F.col("_known").isNull(), F.lit("invalid API key")
    )
    return hashed.join(known, "key_hash", "left").withColumn("key_error", error).drop("_known", "key_hash")


# ---- plans -------------------------------------------------------------------------------------


def free_plan() -> Column:
    values = [F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for v in FREE_PLAN.values()]
    return F.struct(*[v.cast(_PLAN_TYPES[n]).alias(n) for n, v in zip(FREE_PLAN, values)])


def with_plan(requests: DataFrame, owner: str, plans: DataFrame, trusted: str | None = None) -> DataFrame:
    """Adds ``plan``. ``plans`` has (owner, plan fields); of several rows of an owner the last by name counts.

    Whether the plan side is broadcast is left to the optimizer, which knows its size.
    """
    plan = F.struct(*[F.col(c).cast(t).alias(c) for c, t in _PLAN_TYPES.items()])
    side = plans.groupBy(F.col("owner").alias("_owner")).agg(F.max_by(plan, "name").alias("_plan"))
    joined = requests.join(side, F.col(owner) == F.col("_owner"), "left")
    given = [F.col(trusted)] if trusted else []
    return joined.withColumn("plan", F.coalesce(*given, "_plan", free_plan())).drop("_owner", "_plan")


def effective_rate(plan: str = "plan") -> Column:
    """Requests per minute of a plan."""
    rate = F.col(f"{plan}.max_rate_per_min")
    return F.when(F.coalesce(rate, F.lit(0)) <= 0, F.lit(DEFAULT_RATE)).otherwise(rate)


def result_ttl_seconds(hours: Column) -> Column:
    """Retention of a plan in seconds; 0 means the default."""
    return F.when(F.coalesce(hours, F.lit(0)) <= 0, F.lit(0)).otherwise(F.least(hours, F.lit(MAX_RETENTION_HOURS)) * 3600).cast("long")


def effective_ttl_seconds(requested: Column) -> Column:
    """G8."""
    return F.when(requested <= 0, F.lit(DEFAULT_TTL_SECONDS)).otherwise(F.least(requested, F.lit(MAX_RETENTION_HOURS * 3600))).cast("long")


def crawl_caps(df: DataFrame, pages="max_pages", depth="max_depth", timeout="max_timeout", fmt="format", plan="plan", fixed_timeout=False) -> DataFrame:
    """G1: defaults and caps of crawl requests, in place."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    plan_cap = F.coalesce(F.col(f"{plan}.max_crawl_pages"), F.lit(0))
    asked = F.when(zero(pages) <= 0, F.lit(10)).otherwise(zero(pages))
    capped = F.least(F.when(plan_cap > 0, F.least(asked, plan_cap)).otherwise(asked), F.lit(1000))
    seconds = F.lit(300) if fixed_timeout else F.when(zero(timeout) <= 0, F.lit(300)).otherwise(F.least(zero(timeout), F.lit(600)))
    return df.withColumns(
        {
            pages: capped.cast("int"),
            depth: F.when(zero(depth) <= 0, F.lit(3)).otherwise(F.least(zero(depth), F.lit(10))).cast("int"),
            timeout: seconds.cast("int"),
            fmt: F.when(F.coalesce(F.col(fmt), F.lit("")) == "", F.lit("markdown")).otherwise(F.col(fmt)),
        }
    )


# ---- admission ---------------------------------------------------------------------------------


def admit(requests: DataFrame, dns: DataFrame, extraction_available: bool = True) -> DataFrame:
    """Verdict of scrape, crawl and extract requests; first failing rule.

    ``requests`` has (request_id, kind, url, format, extract_schema, plan, ...), and ``readable`` if some bodies could not be
    parsed: these are refused first, whatever they hold. Crawls are judged and passed on with their caps applied
    (``crawl_caps``) if they have them. Adds http_code, error,
    tier, strategy, reason, pinned_ip and, for accepted rows, stream.
    """
    limits = ("max_pages", "max_depth", "max_timeout")
    if set(limits) <= set(requests.columns):
        before = requests.withColumns({f"_{c}": F.col(c) for c in (*limits, "format")})
        is_crawl = F.col("kind") == "crawl"
        own = {c: F.when(is_crawl, F.col(c)).otherwise(F.col(f"_{c}")) for c in limits}
        requests = crawl_caps(before).withColumns({**own, "format": F.col("_format")}).drop(*[f"_{c}" for c in (*limits, "format")])
    checked = validate_urls(requests, "url", dns).withColumn("_route", classify_url(Q.col("url")).col)
    is_extract = F.col("kind") == "extract"
    fmt = F.when(is_extract | (F.coalesce(F.col("format"), F.lit("")) == ""), F.lit("markdown")).otherwise(F.col("format"))
    bad_schema = schema_error(Q.col("extract_schema")).col
    allowed = is_tier_allowed(Q.col("_route.tier"), Q.col("plan.allowed_tiers")).col
    readable = F.coalesce(F.col("readable"), F.lit(False)) if "readable" in requests.columns else F.lit(True)
    rules = [
        (is_extract & F.lit(not extraction_available), 503, F.lit("extraction service not configured")),
        (~readable, 400, F.lit("invalid request body")),
        (is_extract & ~F.coalesce(F.col("plan.can_extract"), F.lit(False)), 403, F.lit("extract is not available on your current plan")),
        (F.coalesce(F.col("url"), F.lit("")) == "", 400, F.lit("url is required")),
        (~F.col("url_ok"), 400, F.col("url_error")),
        (is_extract & F.col("_schema_error").isNotNull(), 400, F.col("_schema_error")),
        (~fmt.isin("markdown", "html", "text"), 400, F.lit("format must be markdown, html, or text")),
        (
            ~F.coalesce(allowed, F.lit(False)),
            403,
            F.concat(F.lit("this URL requires the "), F.col("_route.tier"), F.lit(" tier, upgrade your plan")),
        ),
    ]
    code, error = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(""))
    for test, number, text in rules:
        code, error = code.when(test, F.lit(number)), error.when(test, text)
    verdict = checked.withColumn("_schema_error", bad_schema).withColumn("http_code", code.otherwise(F.lit(202))).withColumn("error", error)
    accepted = F.col("http_code") == 202
    stream = F.when(F.col("kind") == "crawl", F.lit("crawl_jobs")).otherwise(queue_for_tier(Q.col("_route.tier")).col)
    return (
        verdict.withColumn("format", fmt)
        .withColumn("tier", F.col("_route.tier"))
        .withColumn("strategy", F.col("_route.strategy"))
        .withColumn("reason", F.col("_route.reason"))
        .withColumn("stream", F.when(accepted, stream))
        .drop("_route", "_schema_error", "url_ok", "url_error")
    )


# ---- signed plans ------------------------------------------------------------------------------


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA256 built from ``sha2``; only the two padded keys are computed on the driver."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner_pad, outer_pad = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    inner = F.sha2(F.concat(F.lit(inner_pad), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)


def sign_plan(secret: str, owner: Column, plan: Column, ts: Column, method: Column, uri: Column) -> Column:
    """Signature over the five fields."""
    return hmac_sha256(secret, F.concat_ws("\n", owner, plan, ts, method, uri))


def _plan_json_ok(text: Column) -> Column:
    """A JSON object (or null) whose known fields have the right type."""
    v = F.try_parse_json(text)
    ok = v.isNotNull() & (F.schema_of_variant(v).startswith("OBJECT") | (F.schema_of_variant(v) == "VOID"))
    for name, kind in _PLAN_TYPES.items():
        found = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        wanted = {"string": ["STRING"], "bigint": ["BIGINT"], "boolean": ["BOOLEAN"]}.get(kind, ["ARRAY<STRING>", "ARRAY<VOID>"])
        ok = ok & F.coalesce(found.isin(*wanted, "VOID"), F.lit(True))
    return ok


def signed_plan_verdicts(df: DataFrame, secret: str, owner="owner", plan="plan_b64", ts="ts", sig="signature", method="method", uri="uri", now="now") -> DataFrame:
    """Adds ``verdict`` (direct, trusted, or the reject reason) and the trusted ``plan``.

    ``now`` is the request's arrival in epoch seconds.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in (owner, plan, ts, sig, method, uri)}
    read = df.withColumns(
        {
            "_want": sign_plan(secret, text[owner], text[plan], text[ts], text[method], text[uri]),
            "_sec": F.when(text[ts].rlike(r"^[+-]?[0-9]+\z"), text[ts].try_cast("bigint")),
            "_raw": F.when(
                F.regexp_replace(text[plan], r"[\r\n]", "").rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"),
                F.expr(f"make_valid_utf8(CAST(unbase64(regexp_replace(`{plan}`, '[\\\\r\\\\n]', '')) AS STRING))"),
            ),
        }
    )
    verdict = (
        F.when((text[owner] == "") & (text[plan] == "") & (text[ts] == "") & (text[sig] == ""), F.lit("direct"))
        .when(F.col("_want") != text[sig], F.lit("bad_signature"))
        .when(F.col("_sec").isNull(), F.lit("bad_timestamp"))
        .when(F.abs(F.col(now) - F.col("_sec")) > MAX_SKEW_SECONDS, F.lit("stale_timestamp"))
        .when(~text[owner].rlike(r"^[0-9a-f]{64}\z"), F.lit("bad_owner"))
        .when(F.col("_raw").isNull(), F.lit("bad_plan_encoding"))
        .when(~F.coalesce(_plan_json_ok(F.col("_raw")), F.lit(False)), F.lit("bad_plan_json"))
        .otherwise(F.lit("trusted"))
    )
    judged = read.withColumn("verdict", verdict)
    return judged.withColumn("plan", F.when(F.col("verdict") == "trusted", F.from_json("_raw", PLAN_SCHEMA))).drop("_want", "_sec", "_raw")


# ---- usage -------------------------------------------------------------------------------------


def usage_rollup(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Credits and bytes per owner and month against the plan's limits.

    ``usage`` has (owner, ts, credits, bytes, success). Sums are partial before the shuffle, so an owner
    with most of the rows costs one row per task.
    """
    monthly = usage.groupBy("owner", F.date_trunc("month", "ts").cast("date").alias("month")).agg(
        F.sum("credits").cast("long").alias("credits"),
        F.sum("bytes").cast("long").alias("bytes"),
        F.count("*").alias("requests"),
        F.count(F.when(F.col("success"), 1)).alias("succeeded"),
    )
    limited = with_plan(monthly, "owner", plans)
    return limited.select(
        "owner",
        "month",
        "credits",
        "bytes",
        "requests",
        "succeeded",
        F.col("plan.name").alias("plan_name"),
        (F.col("credits") > F.col("plan.max_credits_per_month")).alias("over_credits"),
        (F.col("bytes") > F.col("plan.max_bandwidth_gb") * F.lit(1 << 30)).alias("over_bandwidth"),
    )
