"""Bounded breadth-first crawls over a stored page snapshot.

All crawls advance together, one level per step. A page's rank in its crawl is fixed by the rank of the
first page that links to it and the position of that link, so ranks need no queue: a level is one
aggregation, one anti join against what was seen, and two windows per crawl. Pages are reduced once to
narrow rows (outcome, size, link targets); bodies are joined back only at the end. Every level is written
to a shared folder with a manifest, so a lost executor never repeats earlier levels, and a lost driver goes on after them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window, functions as S

from pagewright.functions import html as H
from pagewright.functions.sql import fn as F
from pagewright.functions.urls import normalize_url, url_parts
from pagewright.operators.pages import anchor_hrefs, crawl_title, followed_links
from pagewright.operators.rows import explode_array
from pagewright.session import open_bucketed, read_folder, shared_folder, write_bucketed, write_through
from pagewright.sources.snapshot import FETCH_FAILED, cap_body, fetch_error

CRAWL_BYTE_LIMIT = 100 * 1024 * 1024
OVER_LIMIT = "total crawl size limit exceeded"


def crawl_site(snapshot: DataFrame, key: str = "page_id") -> DataFrame:
    """One narrow row per normalized URL: outcome, title, size and link targets of its first page.

    Pages are parsed where they lie; only the narrow rows are shuffled.
    """
    pages = snapshot.select(
        key, "status", "html", normalize_url(F.col("url")).alias("_norm").col, fetch_error(F.col("status"), F.col("content_type")).alias("_error").col
    )
    body = F.when(F.col("_error").isNull(), cap_body(F.col("html"))).otherwise("")
    wanted = F.filter(H.tag_array(F.col("_body")), lambda t: H.is_tag(t, "a") | H.is_tag(t, "title"))
    parsed = pages.select("_norm", key, "status", "_error", body.alias("_body").col).select(
        "_norm", key, "status", "_error", S.octet_length("_body").cast("long").alias("_bytes"), wanted.alias("_tags").col
    )
    narrow = parsed.select(
        "_norm",
        S.struct(
            key,
            S.col("status").cast("int").alias("_status"),
            "_error",
            "_bytes",
            crawl_title(F.col("_tags")).alias("_title").col,
            anchor_hrefs(F.col("_tags")).alias("_hrefs").col,
        ).alias("_page"),
    )
    return narrow.groupBy("_norm").agg(S.min_by("_page", S.col(f"_page.{key}")).alias("_page")).select("_norm", "_page.*")


class CrawlStore:
    """What a crawl has done, in a folder: the site, its levels, and a manifest of what is whole.

    The site is dealt out by URL once; every level joins it where it lies and moves only its own rows. All levels are one
    table, dealt out by crawl and URL with a sub-folder per attempt at a level, so what was seen is read where it
    lies and once a level. An attempt counts when the manifest names it; rows of one that died are never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.whole = {r.depth: r for r in read_folder(spark, f"{path}/manifest", "depth int, attempt string, rows long, buckets int").collect()}
        first = next(iter(self.whole.values()), None)
        self.buckets = first.buckets if first else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def _enter(self, depth: int, attempt: str, rows: int) -> None:
        entry = Row(depth=depth, attempt=attempt, rows=rows, buckets=self.buckets)
        kinds = {"depth": "int", "attempt": "string", "rows": "long", "buckets": "int"}
        row = self.spark.range(1, numPartitions=1).select(*[S.lit(entry[c]).cast(k).alias(c) for c, k in kinds.items()])
        row.write.mode("append").parquet(f"{self.path}/manifest")
        self.whole[depth] = entry

    def site(self, make: DataFrame) -> DataFrame:
        """The site, dealt out by URL; made by the first run only."""
        if SITE not in self.whole:
            attempt = uuid.uuid4().hex
            write_bucketed(make, ["_norm"], f"{self.path}/site-{attempt}", self.buckets)
            self._enter(SITE, attempt, 0)
        place = f"{self.path}/site-{self.whole[SITE].attempt}"
        return self.spark.table(open_bucketed(self.spark, make.schema, ["_norm"], place, self.buckets))

    def append(self, rows: DataFrame, depth: int) -> int:
        """Store the rows of a level; how many there are."""
        attempt, seen = f"{depth}-{uuid.uuid4().hex}", Observation()
        counted = rows.withColumn("attempt", S.lit(attempt)).observe(seen, S.count(S.lit(1)).alias("n"))
        self.table = write_bucketed(counted, ["job_id", "_norm"], f"{self.path}/levels", self.buckets, "attempt")
        self._enter(depth, attempt, seen.get["n"])
        return seen.get["n"]

    def open(self, schema) -> None:
        """Find the levels of an earlier run."""
        self.table = self.spark.table(open_bucketed(self.spark, schema.add("attempt", "string"), ["job_id", "_norm"], f"{self.path}/levels", self.buckets, "attempt"))

    def level(self, depth: int) -> DataFrame:
        return self.table.filter(S.col("attempt") == self.whole[depth].attempt).drop("attempt")

    def seen(self) -> DataFrame:
        """All rows of whole levels."""
        return self.table.filter(S.col("attempt").isin([r.attempt for d, r in self.whole.items() if d != SITE])).drop("attempt")


#: The site's entry in the manifest, beside the depths of levels.
SITE = -1


def _seeds(jobs: DataFrame) -> DataFrame:
    seeds = jobs.withColumn("_p", url_parts(F.col("url")).col)
    return seeds.select(
        "job_id",
        "url",
        normalize_url(F.col("url")).alias("_norm").col,
        S.col("_p.ok").alias("_seed_ok"),
        S.col("_p.host").alias("_host"),
        S.col("max_pages").cast("long").alias("_max_pages"),
        S.col("max_depth").cast("int").alias("_max_depth"),
        S.col("include_patterns").alias("_include"),
        S.col("exclude_patterns").alias("_exclude"),
    )


# What a crawl may follow and how far; carried along so that a level depends on the level before it only.
_RULES = ["_host", "_include", "_exclude", "_max_pages", "_max_depth"]


def crawl(jobs: DataFrame, snapshot: DataFrame, key: str = "page_id", byte_limit: int = CRAWL_BYTE_LIMIT, path: str | None = None) -> DataFrame:
    """(job_id, rank, depth, url, status_code, title, bytes, error, key), one row per processed page.

    ``jobs`` has (job_id, url, max_pages, max_depth, include_patterns, exclude_patterns). The crawl is kept in ``path``, a
    folder that all executors share, or in a new one. A crawl of the same jobs that finds whole levels there goes on after
    the last of them.
    """
    spark = jobs.sparkSession
    seeds = write_through(_seeds(jobs).filter("_seed_ok").drop("_seed_ok"))
    limits = seeds.agg(S.max("_max_pages"), S.max("_max_depth")).first()
    most_pages, most_depth = limits[0] or 0, limits[1] or 0
    store = CrawlStore(spark, path or shared_folder(spark))
    site = store.site(crawl_site(snapshot, key))
    one, zero = S.lit(1).cast("long"), S.lit(0).cast("long")
    first = seeds.filter("_max_pages > 0").select("job_id", "url", "_norm", one.alias("rank"), S.lit(0).alias("depth"), zero.alias("_used"), *_RULES)
    level = _fetch(first, site, byte_limit, key)
    store.open(level.schema)
    for depth in range(most_depth + 1):
        if depth not in store.whole:
            if depth:
                before = store.level(depth - 1)
                level = _fetch(_discover(store.seen(), before, _going_on(before), most_pages), site, byte_limit, key)
            store.append(level, depth)
        if not store.whole[depth].rows:
            break
    return store.seen().select("job_id", "rank", "depth", "url", "status_code", "title", "bytes", "error", key)


def _fetch(frontier: DataFrame, site: DataFrame, byte_limit: int, key: str) -> DataFrame:
    """Outcome of every page of a level, with the byte budget applied in rank order (C4)."""
    met = frontier.hint("merge").join(site, "_norm", "left")
    error = S.when(S.col(key).isNull(), S.lit(FETCH_FAILED)).otherwise(S.col("_error"))
    bytes_ = S.coalesce("_bytes", S.lit(0).cast("long"))
    in_order = Window.partitionBy("job_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    total = met.withColumn("_size", bytes_).withColumn("_total", S.col("_used") + S.sum("_size").over(in_order))
    kept = total.filter((S.col("_total") - S.col("_size")) <= byte_limit)
    crossed = S.col("_total") > byte_limit
    return kept.select(
        "job_id",
        "url",
        "_norm",
        "rank",
        "depth",
        S.coalesce("_status", S.lit(0)).alias("status_code"),
        S.coalesce("_title", S.lit("")).alias("title"),
        S.when(crossed, S.lit(0).cast("long")).otherwise(S.col("_size")).alias("bytes"),
        S.when(crossed, S.lit(OVER_LIMIT)).otherwise(error).alias("error"),
        key,
        "_total",
        crossed.alias("_crossed"),
        "_hrefs",
        *_RULES,
    )


def _going_on(level: DataFrame) -> DataFrame:
    """Crawls that go on after a level, with their page and byte counts, their depth and their rules."""
    done = level.groupBy("job_id").agg(
        S.max("rank").alias("_pages"),
        S.max("depth").alias("_depth"),
        S.max("_total").alias("_used"),
        S.bool_or("_crossed").alias("_stop"),
        *[S.first(c).alias(c) for c in _RULES],
    )
    return done.filter(~S.col("_stop") & (S.col("_pages") < S.col("_max_pages")) & (S.col("_max_depth") > S.col("_depth"))).drop("_stop")


def _discover(seen: DataFrame, level: DataFrame, going_on: DataFrame, most_pages: int) -> DataFrame:
    """The next level: new links of usable pages, first discovery wins."""
    usable = level.filter(S.col("error").isNull() & (S.col("bytes") > 0)).drop("_used")
    sources = usable.join(going_on.select("job_id"), "job_id", "left_semi")
    links = followed_links(F.col("url"), F.col("_hrefs"), F.col("_host"), F.col("_include"), F.col("_exclude"))
    # Written, as the plan of what follows is made anew after each of its shuffles and the links are a long expression.
    found = write_through(explode_array(sources, ["job_id", S.col("rank").alias("_parent")], links.col, "_pos", "url"))
    first = (
        # A serialized link has no fragment and an encoded path; only slashes at its end remain.
        found.withColumn("_norm", S.regexp_replace("url", r"/+\z", ""))
        .groupBy("job_id", "_norm")
        .agg(S.min(S.struct("_parent", "_pos", "url")).alias("_first"))
    )
    fresh = first.join(seen.select("job_id", "_norm"), ["job_id", "_norm"], "left_anti")
    order = Window.partitionBy("job_id").orderBy("_first._parent", "_first._pos")
    # The constant limit lets every task drop surplus links before the shuffle; each crawl's own limit follows.
    ranked = fresh.withColumn("_n", S.row_number().over(order)).filter(S.col("_n") <= most_pages)
    return (
        ranked.join(going_on, "job_id")
        .withColumn("rank", S.col("_pages") + S.col("_n"))
        .filter(S.col("rank") <= S.col("_max_pages"))
        .select("job_id", S.col("_first.url").alias("url"), "_norm", "rank", (S.col("_depth") + 1).alias("depth"), "_used", *_RULES)
    )


def crawl_summary(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Final status of every crawl; pages with an error count but give no result."""
    counts = results.groupBy("job_id").agg(
        S.count("*").alias("pages"), S.count(S.when(S.col("error").isNull(), 1)).alias("good")
    )
    seeds = _seeds(jobs).select("job_id", "_seed_ok")
    total = S.coalesce("pages", S.lit(0).cast("long"))
    return seeds.join(counts, "job_id", "left").select(
        "job_id",
        S.when(S.col("_seed_ok"), S.lit("completed")).otherwise(S.lit("failed")).alias("status"),
        total.alias("pages_total"),
        total.alias("pages_completed"),
        S.coalesce("good", S.lit(0).cast("long")).alias("results"),
    )


def crawl_results(results: DataFrame, snapshot: DataFrame, key: str = "page_id") -> DataFrame:
    """Results of each crawl in page order with the stored HTML as content.

    A crawl holds at most its page limit and 100 MiB of content, which bounds every group.
    """
    good = results.filter(S.col("error").isNull()).join(snapshot.select(key, "html"), key)
    page = S.struct(
        "rank",
        S.struct(
            S.lit(True).alias("success"),
            S.struct(
                cap_body(F.col("html")).col.alias("content"),
                S.struct(S.col("title"), S.col("status_code")).alias("metadata"),
            ).alias("data"),
        ).alias("result"),
    )
    grouped = good.groupBy("job_id").agg(S.sort_array(S.collect_list(page)).alias("_r"))
    return grouped.select("job_id", S.transform("_r", lambda r: r["result"]).alias("results"))


def crawl_status_events(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, seq, status, pages_completed): queued, running after each level, then the final status."""
    seeds = _seeds(jobs)
    queued = seeds.select("job_id", S.lit(0).alias("seq"), S.lit("queued").alias("status"), S.lit(0).cast("long").alias("pages_completed"))
    started = seeds.filter("_seed_ok").select(
        "job_id", S.lit(1).alias("seq"), S.lit("running").alias("status"), S.lit(0).cast("long").alias("pages_completed")
    )
    per_level = results.groupBy("job_id", "depth").agg(S.max("rank").alias("pages_completed"))
    running = per_level.select("job_id", (S.col("depth") + 2).alias("seq"), S.lit("running").alias("status"), "pages_completed")
    final = crawl_summary(jobs, results).select("job_id", S.lit(1 << 30).alias("seq"), "status", "pages_completed")
    return queued.unionByName(started).unionByName(running).unionByName(final)
