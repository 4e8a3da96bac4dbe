"""Address safety over URL and DNS tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as S

from pagewright.functions.sql import Expr as Column, fn as F

from pagewright.functions.addresses import host_is_private_literal, ipv4_number, ipv6_hex, is_private_address
from pagewright.functions.text import let
from pagewright.functions.urls import GATEWAY, is_web_scheme, redact_url, request_parts, url_parts
from pagewright.operators.ranges import match_ranges

BAD_URL = "invalid url"
BAD_SCHEME = "url scheme must be http or https"
NO_HOST = "url must include a hostname"
NO_ADDRESS = "cannot resolve hostname: "
PRIVATE = "url resolves to a private or reserved IP address"

MAX_REDIRECTS = 5


def host_addresses(dns: DataFrame, dialect: str = GATEWAY) -> DataFrame:
    """One row per host. ``dns`` has (host, pos, ip); map-side aggregation keeps hot hosts small."""
    ip = F.col("ip")
    checked = dns.select(
        "host",
        "pos",
        "ip",
        _is_address(ip).alias("readable").col,
        F.coalesce(is_private_address(ip, dialect), False).alias("private").col,
    )
    return checked.groupBy("host").agg(
        S.bool_or("private").alias("any_private"),
        S.min(S.when(S.col("readable"), S.struct("pos", "ip"))).getField("ip").alias("first_ip"),
    )


def addresses_in_ranges(dns: DataFrame, ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """N3 over a table of ranges: ``host_addresses``, an address being private if any range holds it."""
    matched = match_ranges(dns.select("host", "pos", "ip"), "ip", ranges, cidr)
    readable = matched.select("host", "pos", "ip", _is_address(F.col("ip")).alias("readable").col, S.col("range").isNotNull().alias("private"))
    return readable.groupBy("host").agg(
        S.bool_or("private").alias("any_private"),
        S.min(S.when(S.col("readable"), S.struct("pos", "ip"))).getField("ip").alias("first_ip"),
    )


def _is_address(ip: Column) -> Column:
    return F.coalesce(ipv4_number(ip).isNotNull() | ipv6_hex(ip).isNotNull(), False)


def validate_urls(df: DataFrame, url: str, dns: DataFrame, dialect: str = GATEWAY, ranges: DataFrame | None = None) -> DataFrame:
    """Adds url_ok, url_error and pinned_ip. With ``ranges`` (cidr, ...), these say which addresses are private.

    The host side is reduced to one row per host first, so a host with a third of all URLs only
    makes one side of the join large, which adaptive execution splits. An address literal is its
    own resolution.
    """
    addresses = (host_addresses(dns, dialect) if ranges is None else addresses_in_ranges(dns, ranges)).withColumnRenamed("host", "_host")
    parsed = df.withColumn("_p", request_parts(F.col(url)).col)
    host = F.col("_p.host")
    parsed = parsed.withColumn("_literal", _is_address(host).col)
    if ranges is None:
        parsed = parsed.withColumn("_literal_private", F.coalesce(is_private_address(host, dialect), False).col)
    else:
        literal = parsed.withColumn("_ip", F.when(F.col("_literal"), host).col)
        parsed = match_ranges(literal, "_ip", ranges, name="_range").withColumn("_literal_private", S.col("_range").isNotNull()).drop("_range", "_ip")
    joined = parsed.join(addresses, S.col("_p.host") == S.col("_host"), "left")
    private = F.coalesce(F.col("any_private"), False) | (F.col("_literal") & F.col("_literal_private"))
    pinned = F.when(F.col("_literal"), host).otherwise(F.col("first_ip"))
    error = (
        F.when(~F.col("_p.ok"), BAD_URL)
        .when(~is_web_scheme(F.col("_p.scheme")), BAD_SCHEME)
        .when(host == "", NO_HOST)
        .when(private, PRIVATE)
        .when(pinned.isNull(), F.concat(NO_ADDRESS, host))
    )
    return (
        joined.withColumn("url_error", error.col)
        .withColumn("url_ok", S.col("url_error").isNull())
        .withColumn("pinned_ip", F.when(F.col("url_ok"), pinned).col)
        .drop("_p", "_literal", "_literal_private", "_host", "any_private", "first_ip")
    )


def browser_verdict(url: Column, resolved_ip: Column) -> Column:
    """N4, browser dialect: NULL when the URL is safe, else the reason."""

    def verdict(p: Column) -> Column:
        return (
            F.when(redact_url(url, "browser") == "<invalid-url>", F.lit(BAD_URL))
            .when(~is_web_scheme(p["scheme"]), F.lit("SSRF: only http and https schemes are allowed"))
            .when(host_is_private_literal(p["host"]), F.lit("SSRF: URL hostname is a private/reserved IP"))
            .when(F.coalesce(resolved_ip, F.lit("")) == "", F.lit("SSRF: resolved_ip is required"))
            .when(is_private_address(resolved_ip, "browser"), F.lit("SSRF: resolved IP is private/reserved"))
        )

    return let(url_parts(url), verdict)


def redirect_verdicts(hops: DataFrame, dns: DataFrame, dialect: str = GATEWAY) -> DataFrame:
    """One row per chain of ``hops(chain_id, hop, url)``; hop 1 is the first redirect target."""
    checked = validate_urls(hops, "url", dns, dialect)
    # The first failing hop decides; the count test comes before the address test on the same hop.
    problem = S.when(S.col("hop") >= MAX_REDIRECTS, S.lit("too many redirects")).when(
        ~S.col("url_ok"), S.lit("redirect to private address blocked")
    )
    return checked.groupBy("chain_id").agg(
        S.max("hop").cast("long").alias("hops"),
        S.min(S.when(problem.isNotNull(), S.struct("hop", problem.alias("problem")))).getField("problem").alias("error"),
    )
