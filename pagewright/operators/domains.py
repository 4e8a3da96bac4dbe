"""Longest-suffix join of hosts with a table of domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as S

from pagewright.functions.sql import Expr, expr, fn as F
from pagewright.functions.text import let
from pagewright.functions.urls import GATEWAY, url_parts
from pagewright.operators.routing import PROTECTED_DOMAINS, classify_url
from pagewright.session import write_through

#: How a row's name is compared with a host: the host itself or any below it; only hosts below it; only itself; hosts
#: whose first labels it is, with more to follow.
DOMAIN, BELOW, EXACT, FIRST = "domain", "below", "exact", "first"
PROTECTED, STATIC_DOC = "protected", "static_doc"

# Hosts that serve static documentation, by how they are compared.
STATIC_DOC_NAMES = {
    BELOW: ("readthedocs.io", "github.io", "rtfd.io", "gitbook.io"),
    FIRST: ("docs", "wiki", "man", "manpages", "javadoc", "apidoc", "apidocs"),
    EXACT: ("en.wikipedia.org", "developer.mozilla.org"),
}


def default_domains(spark) -> DataFrame:
    """The shipped lists as a table (name, match, list); callers add their own rows."""
    rows = [(d, DOMAIN, PROTECTED) for d in PROTECTED_DOMAINS] + [(n, m, STATIC_DOC) for m, names in STATIC_DOC_NAMES.items() for n in names]
    return spark.createDataFrame(rows, "name string, match string, list string")


def host_keys(host, most: Expr | int) -> Expr:
    """ARRAY<STRUCT<match, name, labels>>: all rows of a domain table that could hold for a host, of up to ``most`` labels."""

    def keys(labels: Expr) -> Expr:
        n = F.size(labels)
        lengths = F.filter(F.sequence(1, F.greatest(F.least(n, Expr(str(most)) if isinstance(most, int) else most), 1)), lambda k: k <= n)
        row = lambda match, name, k: F.struct(F.lit(match).alias("match"), name.alias("name"), k.alias("labels"))
        last = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
        first = lambda k: F.array_join(F.slice(labels, 1, k), ".")
        own = F.filter(F.transform(lengths, lambda k: row(EXACT, last(k), k)), lambda x: x["labels"] == n)
        below = F.transform(F.filter(lengths, lambda k: k < n), lambda k: row(BELOW, last(k), k))
        ahead = F.transform(F.filter(lengths, lambda k: k < n), lambda k: row(FIRST, first(k), k))
        return F.concat(own, F.transform(lengths, lambda k: row(DOMAIN, last(k), k)), below, ahead)

    return let(F.split(expr(host), r"\."), keys)


def longest_suffixes(hosts: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """(host, list, name): for each distinct host and list, the name that holds for it with the most labels.

    ``domains`` has (name, match, list). A host looks up its own first and last labels, as many as the longest name has, so
    the join is an equal one at any number of names; of equally long names the first in the order domain, exact, below, first
    holds. Names are looked up as they stand, hosts lower-cased. The side of the names is a written table with one row per key:
    a suffix that most hosts share makes only their side large, and it is broadcast only where its measured size allows.
    """
    names = domains.filter("name IS NOT NULL AND name <> ''").select("name", "match", "list").distinct()
    table = write_through(names.groupBy("match", "name").agg(S.array_sort(S.collect_set("list")).alias("_lists")))
    most = table.agg(S.max(S.size(S.split("name", r"\.")))).first()[0] or 0
    distinct = hosts.select(S.col(host).alias("host")).filter("host IS NOT NULL AND host <> ''").distinct()
    keys = distinct.select("host", S.explode(host_keys(F.lower(F.col("host")), most).col).alias("_key")).select("host", "_key.*")
    order = S.expr(f"array_position(array('{FIRST}', '{BELOW}', '{EXACT}', '{DOMAIN}'), match)")
    found = keys.join(table, ["match", "name"]).select("host", S.explode("_lists").alias("list"), S.struct("labels", order.alias("order"), "name").alias("_m"))
    return found.groupBy("host", "list").agg(S.max("_m").alias("_m")).select("host", "list", "_m.name")


def match_domains(df: DataFrame, host: str, domains: DataFrame, lists: tuple[str, ...] = (PROTECTED, STATIC_DOC)) -> DataFrame:
    """``df`` with a column per list: the longest name that holds for the host, or NULL. Copies of a host are looked up once."""
    found = longest_suffixes(df, host, domains).filter(S.col("list").isin(*lists))
    wide = write_through(found.groupBy(S.col("host").alias("_matched_host")).agg(*[S.max(S.when(S.col("list") == n, S.col("name"))).alias(n) for n in lists]))
    return df.join(wide, S.col(host) == S.col("_matched_host"), "left").drop("_matched_host")


def classify_urls(df: DataFrame, url: str, domains: DataFrame, dialect: str = GATEWAY, headers: Expr | None = None, name: str = "route") -> DataFrame:
    """U19 with the lists of ``domains``: ``df`` with the column ``name``."""
    hosted = df.withColumn("_host", F.lower(url_parts(F.col(url), dialect)["host"]).col)
    matched = match_domains(hosted, "_host", domains)
    return matched.withColumn(name, classify_url(F.col(url), dialect, headers, F.col(PROTECTED), F.col(STATIC_DOC)).col).drop("_host", PROTECTED, STATIC_DOC)
