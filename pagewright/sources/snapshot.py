"""The stored page snapshot that stands in for live fetching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as S

from pagewright.functions.sql import Expr, fn as F
from pagewright.functions.urls import normalize_url

BODY_CAP = 10 * 1024 * 1024
FETCH_FAILED = "fetch failed"


#: Session setting of a caller whose files have too few row groups to split: rows are dealt to so many partitions.
READ_PARTITIONS = "spark.pagewright.read.partitions"


def read_table(spark, folder: str, name: str) -> DataFrame:
    """A stored table as its files lie, at any size, unless the caller set ``READ_PARTITIONS``."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    asked = spark.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(asked)) if asked else df


def read_pages(spark, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages")


def cap_body(html: Expr, mode: str = "truncate", cap: int = BODY_CAP) -> Expr:
    """S3: bodies over the cap are cut (``truncate``) or become NULL (``fail``); sizes are bytes."""
    over = F.octet_length(html) > cap
    if mode == "fail":
        return F.when(~over, html)
    cut = F.make_valid_utf8(F.substring(F.encode(html, "UTF-8"), 1, cap).cast("string"))
    return F.when(over, cut).otherwise(html)


def fetch_error(status: Expr, content_type: Expr) -> Expr:
    """Why a fetched page is not used, or NULL. The content type is compared case-sensitively."""
    typed = F.coalesce(content_type, "")
    return (
        F.when(status.isNull(), FETCH_FAILED)
        .when(status >= 400, F.concat("HTTP ", status.cast("string")))
        .when((typed != "") & ~typed.contains("text/html") & ~typed.contains("application/xhtml"), "non-HTML content")
    )


def fetch_outcomes(requests: DataFrame, url: str, snapshot: DataFrame, key: str = "page_id", cap: int = BODY_CAP) -> DataFrame:
    """Each requested URL with its stored page; a URL outside the snapshot fails.

    ``snapshot`` has (key, url, status, content_type, html). Copies of one normalized URL are reduced to
    the first key on narrow rows, before any body moves.
    """
    first = first_keys(snapshot, key)
    asked = requests.withColumn("_norm", normalize_url(F.col(url)).col).join(first, "_norm", "left")
    # Bodies move once, by key, and only after the narrow match.
    stored = snapshot.select(key, "status", "content_type", "html")
    joined = asked.join(stored, key, "left").withColumn("error", fetch_error(F.col("status"), F.col("content_type")).col)
    content = F.when(F.col("error").isNull(), cap_body(F.col("html"), cap=cap)).otherwise("")
    return joined.withColumn("content", content.col).drop("_norm", "html", "content_type")


def first_keys(snapshot: DataFrame, key: str = "page_id") -> DataFrame:
    """(_norm, key): the first page of every normalized URL, from narrow rows."""
    # The coalesce makes the join key non-null, or a null test would evaluate the whole expression again.
    norm = F.coalesce(normalize_url(F.col("url")), "").alias("_norm").col
    return snapshot.filter("url IS NOT NULL").select(key, norm).groupBy("_norm").agg(S.min(key).alias(key))


def worker_pages(snapshot: DataFrame, cap: int = BODY_CAP) -> DataFrame:
    """Pages as the workers see them: bodies over the cap fail, any status is a result."""
    return snapshot.withColumn("html", cap_body(F.col("html"), "fail", cap).col)
