"""URL and response routing: which worker tier a page needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as S

from pagewright.functions.sql import Expr as Column, fn as F

from pagewright.functions.text import let, strip
from pagewright.functions.urls import GATEWAY, redact_url, url_parts

FAST, BROWSER, STEALTH = "fast", "browser", "stealth"

# Domains that need the stealth tier, sub-domains included.
PROTECTED_DOMAINS = (
    "linkedin.com",
    "instagram.com",
    "facebook.com",
    "twitter.com",
    "x.com",
    "tiktok.com",
    "zillow.com",
    "glassdoor.com",
    "indeed.com",
    "yelp.com",
    "amazon.com",
    "airbnb.com",
    "booking.com",
    "pinterest.com",
)

# Hosts that serve static documentation.
STATIC_DOC_HOSTS = (
    r"\.readthedocs\.io$",
    r"\.github\.io$",
    r"^docs\.",
    r"^wiki\.",
    r"^man\.",
    r"^manpages\.",
    r"\.rtfd\.io$",
    r"^javadoc\.",
    r"^apidocs?\.",
    r"\.gitbook\.io$",
    r"^en\.wikipedia\.org$",
    r"^developer\.mozilla\.org$",
)

# Path patterns of single-page applications; the text is part of the reason.
SPA_PATHS = (r"/app(/|$)", r"/dashboard(/|$)", r"/portal(/|$)", r"/console(/|$)", r"/workspace(/|$)")
HASH_ROUTERS = ("/#/", "/#!/")

# First path segments of github.com that are not owners.
RESERVED_OWNERS = (
    "about", "account", "apps", "collections", "contact", "enterprise", "events", "explore", "features", "login",
    "marketplace", "notifications", "orgs", "pricing", "search", "security", "settings", "sponsors", "topics",
    "trending",
)

# Prefixes of response headers set by challenge pages, in order of precedence.
CHALLENGE_HEADERS = ("cf-mitigated", "cf-chl-bypass", "x-datadome", "x-datadome-cid", "x-px-", "x-distil-cs")

# Texts of challenge pages, in order of precedence.
CHALLENGE_TEXTS = (
    "managed by cloudflare",
    "challenge-platform",
    "cf-browser-verification",
    "cf_chl_opt",
    "datadome",
    "perimeterx",
    "distil_r_captcha",
    "just a moment",
    "checking your browser",
    "please verify you are a human",
    "access denied",
)

# Marks of client-rendered pages, in order of precedence.
SPA_MARKS = (
    "data-reactroot",
    "data-react-helmet",
    "__next_data__",
    "__next",
    "__nuxt",
    "__vue_app__",
    "ng-app",
    "ng-version",
    "ember-view",
    "data-turbo",
    "window.__initial_state__",
    "window.__preloaded_state__",
    'id="__next"',
    'id="app"',
    'id="root"',
)

CHALLENGE_BODY_LIMIT = 50_000
SMALL_BODY = 500


def _first_contained(text: Column, needles) -> Column:
    """The first needle, in list order, that occurs in ``text``; NULL if none does."""
    return reduce(lambda c, n: c.when(text.contains(n), F.lit(n)), needles[1:], F.when(text.contains(needles[0]), F.lit(needles[0])))


def route(tier, reason, confidence, strategy="") -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    # Confidence stays within [0, 1].
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_col(confidence).cast("double")))
    return F.struct(
        as_col(tier).alias("tier"), as_col(reason).alias("reason"), bounded.alias("confidence"), as_col(strategy).alias("strategy")
    )


def platform_strategy(host: Column, path: Column, query: Column) -> Column:
    """Name of the platform extractor for a URL, or NULL."""
    segments = F.split(F.btrim(path, F.lit("/")), "/")
    owner, repo = F.get(segments, F.lit(0)), F.get(segments, F.lit(1))
    repo_page = (
        host.isin("github.com", "www.github.com") & (owner != "") & (F.coalesce(repo, F.lit("")) != "") & ~F.lower(owner).isin(*RESERVED_OWNERS)
    )
    readable = F.filter(F.split(query, "&"), lambda p: ~p.contains(";") & ~p.rlike("%(?![0-9A-Fa-f]{2})"))
    ids = F.filter(readable, lambda p: F.url_decode(F.substring_index(p, "=", 1)) == "id")
    first_id = F.url_decode(F.regexp_extract(F.coalesce(F.get(ids, F.lit(0)), F.lit("")), "(?s)=(.*)", 1))
    thread = (host == "news.ycombinator.com") & (path == "/item") & first_id.rlike(r"^[0-9]+\z")
    return F.when(repo_page, F.lit("github_repo")).when(thread, F.lit("hn_thread"))


def protected_domain(host: Column, domains=PROTECTED_DOMAINS) -> Column:
    """The protected domain the host equals or belongs to, or NULL."""
    listed = "|".join(d.replace(".", r"\.") for d in domains)
    return F.nullif(F.regexp_extract(host, rf"(?:^|\.)({listed})\z", 1), F.lit(""))


def is_static_doc_host(host: Column) -> Column:
    """U15."""
    return host.rlike("|".join(p.replace("$", r"\z") for p in STATIC_DOC_HOSTS))


def spa_path(path: Column) -> Column:
    """U16: text of the first pattern that matches the lower-cased path, or NULL."""
    found = F.when(F.lit(False), F.lit(""))
    for pattern in SPA_PATHS:
        found = found.when(path.rlike(pattern.replace("$", r"\z")), F.lit(pattern))
    return found


def hash_router(url: Column) -> Column:
    """The hash-router mark contained in the raw URL, or NULL."""
    return _first_contained(url, HASH_ROUTERS)


def _header(headers: Column | None, name: str) -> Column:
    if headers is None:
        return F.lit("")
    # Keys that differ only in case: the last one wins.
    lowered = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.lower(F.coalesce(F.get(lowered, F.size(lowered) - 1)["value"], F.lit("")))


def _not_html(content_type: Column) -> Column:
    return (content_type != "") & ~content_type.contains("text/html") & ~content_type.contains("application/xhtml")


def classify_url(url: Column, dialect: str = GATEWAY, headers: Column | None = None, protected: Column | None = None, static_doc: Column | None = None) -> Column:
    """STRUCT<tier, reason, confidence, strategy>, first matching rule.

    ``protected`` and ``static_doc`` take the place of the fixed lists: the name that holds for the URL's host, or NULL.
    """

    def probe(p: Column) -> Column:
        host, path = F.lower(p["host"]), F.lower(p["path"])
        strategy = platform_strategy(host, p["path"], p["query"]) if dialect == GATEWAY else F.lit(None).cast("string")
        return F.struct(
            p["ok"].alias("ok"),
            host.alias("host"),
            strategy.alias("strategy"),
            (protected_domain(host) if protected is None else protected).alias("protected"),
            spa_path(path).alias("spa"),
        )

    def decide(s: Column) -> Column:
        mark = hash_router(url)
        content_type = _header(headers, "content-type") if dialect != GATEWAY else F.lit("")
        unparseable = "unparseable URL" if dialect == GATEWAY else "unparseable URL, default fast"
        return (
            F.when(~s["ok"], route(FAST, unparseable, 0.3))
            .when(s["strategy"].isNotNull(), route(FAST, F.concat(F.lit("platform: "), s["strategy"]), 0.9, s["strategy"]))
            .when(s["protected"].isNotNull(), route(STEALTH, F.concat(F.lit("protected domain: "), s["protected"]), 0.9))
            .when(is_static_doc_host(s["host"]) if static_doc is None else static_doc.isNotNull(), route(FAST, F.concat(F.lit("known static doc host: "), s["host"]), 0.9))
            .when(s["spa"].isNotNull(), route(BROWSER, F.concat(F.lit("SPA URL pattern: "), s["spa"]), 0.7))
            .when(mark.isNotNull(), route(BROWSER, F.concat(F.lit("hash-based SPA router: "), mark), 0.8))
            .when(_not_html(content_type), route(FAST, F.concat(F.lit("non-HTML content-type: "), content_type), 0.9))
            .otherwise(route(FAST, "default", 0.5))
        )

    return let(url_parts(url, dialect), lambda p: let(probe(p), decide))


def visible_text(html: Column) -> Column:
    """The text left when every tag is removed."""
    return F.regexp_replace(html, "<[^>]+>", "")


def classify_response(status: Column, headers: Column, body: Column) -> Column:
    """STRUCT<tier, reason, confidence, strategy> of a fetched page, first matching rule."""

    def decide(s: Column) -> Column:
        small = F.length(strip(body)) < SMALL_BODY
        scripts = F.regexp_count(s["lower"], F.lit("<script")) >= 2
        return (
            F.when(_not_html(s["type"]), route(FAST, F.concat(F.lit("non-HTML content-type: "), s["type"]), 0.95))
            .when(s["header"].isNotNull(), route(STEALTH, F.concat(F.lit("challenge header detected: "), s["header"]), 0.9))
            .when(
                status.isin(403, 503) & s["text"].isNotNull(),
                route(STEALTH, F.concat(F.lit("challenge signature in "), status.cast("string"), F.lit(" response: "), s["text"]), 0.9),
            )
            .when(
                s["text"].isNotNull() & (F.length(body) < CHALLENGE_BODY_LIMIT),
                route(STEALTH, F.concat(F.lit("challenge signature in body: "), s["text"]), 0.8),
            )
            .when(small & s["mark"].isNotNull(), route(BROWSER, F.concat(F.lit("small body with SPA indicator: "), s["mark"]), 0.85))
            .when(small & scripts, route(BROWSER, "small body dominated by scripts", 0.7))
            .when(s["mark"].isNotNull(), route(BROWSER, F.concat(F.lit("SPA indicator in body: "), s["mark"]), 0.75))
            .when(F.length(strip(visible_text(body))) > SMALL_BODY, route(FAST, "large static HTML with content", 0.8))
            .otherwise(route(FAST, "default static response", 0.5))
        )

    def probe(lower: Column) -> Column:
        names = F.map_keys(headers)
        by_prefix = F.flatten(F.array(*[_keys_with_prefix(names, p) for p in CHALLENGE_HEADERS]))
        return F.struct(
            lower.alias("lower"),
            _header(headers, "content-type").alias("type"),
            F.get(by_prefix, F.lit(0)).alias("header"),
            _first_contained(lower, CHALLENGE_TEXTS).alias("text"),
            _first_contained(lower, SPA_MARKS).alias("mark"),
        )

    return let(F.lower(body), lambda lower: let(probe(lower), decide))


def _keys_with_prefix(names: Column, prefix: str) -> Column:
    return F.filter(F.transform(names, F.lower), lambda k: k.startswith(prefix))


def route_log(df: DataFrame, job_id: str, url: str, dialect: str = GATEWAY) -> DataFrame:
    """One log row per job, with the URL redacted."""
    u = F.col(url)
    return df.select(job_id, classify_url(u, dialect).alias("route").col, redact_url(u).alias("url").col).select(
        job_id, "route.tier", "route.strategy", "route.reason", "route.confidence", "url"
    )


def route_distribution(routes: DataFrame) -> DataFrame:
    """Rows and mean confidence per tier and reason (partial aggregation before the shuffle)."""
    return routes.groupBy("tier", "reason").agg(S.count("*").alias("n"), S.avg("confidence").alias("avg_confidence"))


def is_tier_allowed(tier: Column, allowed: Column) -> Column:
    """An empty list allows only the fast tier."""
    empty = F.coalesce(F.size(allowed), F.lit(0)) <= 0
    return F.when(empty, tier == FAST).otherwise(F.array_contains(allowed, tier))


def queue_for_tier(tier: Column) -> Column:
    """The stream a tier's jobs go to."""
    return F.when(tier == BROWSER, F.lit("browser_jobs")).when(tier == STEALTH, F.lit("stealth_jobs")).otherwise(F.lit("scrape_jobs"))
