"""Queue entries, job payloads, job status and worker results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.operators.admission import effective_ttl_seconds
from pagewright.operators.rows import entry_order
from pagewright.session import cut_lineage, write_through

STREAM_CAP = 10_000
CLAIM_IDLE_MS, CLAIM_BATCH = 60_000, 100
JOB_NOT_FOUND = "job not found"
GENERIC = "generic"


# ---- payloads (S8) -----------------------------------------------------------------------------


def _json_members(members: list[tuple[str, Column, Column]]) -> Column:
    """A JSON object of the members whose keep-test holds, with <, > and & escaped."""
    parts = F.array_compact(F.array(*[F.when(keep, F.concat(F.lit(f'"{name}":'), value)) for name, value, keep in members]))
    text = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    for char, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028"), ("\u2029", "2029")):
        text = F.replace(text, F.lit(char), F.lit(f"\\u{code}"))
    return text


def _json_string(c: Column) -> Column:
    quoted = F.to_json(F.array(c))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _compact_json(c: Column) -> Column:
    """Drop white space outside strings."""
    return F.regexp_replace(c, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")


def _set(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def scrape_payload(url="url", fmt="format", schema="extract_schema", wait_for="wait_for", timeout="timeout", wait="wait") -> Column:
    """Request JSON; empty fields are left out, pinned address and strategy never appear."""
    c = F.col
    return _json_members(
        [
            ("url", _json_string(F.coalesce(c(url), F.lit(""))), F.lit(True)),
            ("format", _json_string(c(fmt)), _set(c(fmt))),
            ("extract_schema", _compact_json(c(schema)), _set(c(schema))),
            ("wait_for", _json_string(c(wait_for)), _set(c(wait_for))),
            ("timeout", c(timeout).cast("string"), F.coalesce(c(timeout), F.lit(0)) != 0),
            ("wait", F.lit("true"), F.coalesce(c(wait), F.lit(False))),
        ]
    )


def crawl_payload(ttl_seconds: Column) -> Column:
    """S8 for crawl requests; the retention is written in nanoseconds."""
    c = F.col
    number = lambda name: (name, c(name).cast("string"), F.coalesce(c(name), F.lit(0)) != 0)
    patterns = lambda name: (name, F.to_json(c(name)), F.coalesce(F.size(c(name)), F.lit(0)) > 0)
    return _json_members(
        [
            ("url", _json_string(F.coalesce(c("url"), F.lit(""))), F.lit(True)),
            number("max_pages"),
            number("max_depth"),
            number("max_timeout"),
            patterns("include_patterns"),
            patterns("exclude_patterns"),
            ("format", _json_string(c("format")), _set(c("format"))),
            ("result_ttl_ns", (ttl_seconds * 1_000_000_000).cast("string"), ttl_seconds != 0),
        ]
    )


# ---- queue entries -----------------------------------------------------------------------------


def split_entries(entries: DataFrame, dialect: str = "fast") -> tuple[DataFrame, DataFrame]:
    """(usable, malformed) entries of (entry_id, fields MAP). ``fast`` needs a url and falls back to the
    entry id; ``browser`` needs url and job_id, both non-empty."""
    field = lambda name: F.try_element_at("fields", F.lit(name))
    parsed = entries.select(
        "*", field("url").alias("url"), field("job_id").alias("_job"), field("format").alias("format"), field("resolved_ip").alias("resolved_ip"),
        F.nullif(field("strategy"), F.lit("")).alias("strategy"),
    )
    good = F.col("url").isNotNull() if dialect == "fast" else _set(F.col("url")) & _set(F.col("_job"))
    usable = parsed.filter(good).withColumn("job_id", F.coalesce("_job", "entry_id")).drop("_job")
    return usable, parsed.filter(~good).select(entries.columns)


def _recent_entries(entries: DataFrame, cap: int, stream: str, at: str, entry_id: str) -> DataFrame:
    """The entries that can be among the newest ``cap`` of their stream, and few others, with their columns.

    A selection by digits: counts per minute, then, inside the one minute that holds a stream's limit, per instant, and so on
    over the digits of the id's two numbers, until the cell that holds the limit has no more than ``cap`` entries. Counts are
    partial before they are shuffled. Older entries are dropped where they are read, however many share an instant.
    """
    order = entry_order(entry_id)
    least = F.lit(-(1 << 63))
    us, major, minor = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62))), F.coalesce(order["major"], least), order["minor"]
    steps = [F.expr("_us div 60000000"), F.col("_us")]
    steps += [F.shiftright(part, by) for part in ("_major", "_minor") for by in (44, 32, 20, 10, 0)]
    marked = entries.withColumns({"_s": F.col(stream), "_us": us, "_major": major, "_minor": minor})
    cells, limits = [], None
    for i, step in enumerate(steps):
        cells.append(step.alias(f"c{i}"))
        inside = marked.select("_s", "_us", "_major", "_minor")
        if limits is None:
            inside = inside.withColumn("_before", F.lit(0).cast("long"))
        else:
            inside = _beside(inside, limits.withColumnRenamed("_above", "_before")).filter(F.struct(*cells[:-1]) == F.col("_limit"))
        counts = inside.groupBy("_s", F.struct(*cells).alias("_c"), "_before").agg(F.count("*").alias("_n"))
        newest = Window.partitionBy("_s").orderBy(F.col("_c").desc())
        above = counts.withColumn("_above", F.col("_before") + F.sum("_n").over(newest) - F.col("_n")).filter(F.col("_above") < cap)
        limits = write_through(above.groupBy("_s").agg(F.min_by(F.struct("_c", "_above", "_n"), "_c").alias("_l")).select(F.col("_s").alias("_limit_of"), F.col("_l._c").alias("_limit"), "_l._above", "_l._n"))
        if i and (limits.agg(F.max("_n")).first()[0] or 0) <= cap:
            break
    kept = _beside(marked, limits).filter(F.struct(*cells) >= F.col("_limit"))
    return kept.select(*entries.columns, "_us")


def _beside(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with the one row of their stream beside them; a NULL stream is a stream."""
    return rows.join(limits, F.col("_s").eqNullSafe(F.col("_limit_of"))).drop("_limit_of")


def newest_per_stream(entries: DataFrame, cap: int = STREAM_CAP, stream="stream", at="enqueued_at", entry_id="entry_id") -> DataFrame:
    """The newest ``cap`` entries of every stream, by time, then by id as numbers.

    Of a stream, no more than twice ``cap`` entries are ranked, at any number of entries of one instant; ids that are
    not numbers come after all others and, if they share an instant, are ranked together. A NULL time is older than any other.
    """
    recent = _recent_entries(entries, cap, stream, at, entry_id)
    order = Window.partitionBy(stream).orderBy(F.col("_us").desc(), entry_order(entry_id).desc())
    return recent.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).select(entries.columns)


def orphaned_entries(claims: DataFrame, acks: DataFrame, batch: int = CLAIM_BATCH, idle_ms: int = CLAIM_IDLE_MS) -> DataFrame:
    """Unacknowledged entries idle long enough, the first ``batch`` of each group by id as numbers.

    The row-number limit is applied inside every task before the shuffle.
    """
    open_ = claims.filter(F.col("idle_ms") >= idle_ms).join(acks, ["stream", "grp", "entry_id"], "left_anti")
    order = Window.partitionBy("stream", "grp").orderBy(entry_order("entry_id"))
    return open_.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= batch).drop("_n")


def write_queue(jobs: DataFrame, path: str) -> None:
    """One folder per stream, so a worker's read is pruned to its stream."""
    jobs.write.mode("append").partitionBy("stream").parquet(path)


# ---- job status --------------------------------------------------------------------------------


def latest_status(events: DataFrame, job="job_id", seq="seq") -> DataFrame:
    """The last event of every job replaces all before it (partial aggregation, no sort)."""
    rest = [c for c in events.columns if c != job]
    latest = events.groupBy(job).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return latest.select(job, "_last.*")


def upsert_status(current: DataFrame | None, batch: DataFrame, job="job_id", seq="seq") -> DataFrame:
    """S9 as a step: a stored snapshot plus a batch of events. Replaying a batch changes nothing."""
    return latest_status(batch if current is None else current.unionByName(batch), job, seq)


def status_writes(events: DataFrame, at: str, ttl_seconds: Column) -> DataFrame:
    """Status events with ``expires_at`` and ``owner_expires_at``: every write sets both anew, so a job and the
    record of its owner expire together."""
    until = F.col(at) + effective_ttl_seconds(ttl_seconds)
    return events.withColumn("expires_at", until).withColumn("owner_expires_at", until)


def lookup_jobs(lookups: DataFrame, jobs: DataFrame, now: str | None = None) -> DataFrame:
    """Job status for its owner only.

    ``lookups`` has (job_id, caller, ...); ``jobs`` has (job_id, status, owner, pages_total, pages_completed,
    expires_at); of several rows of a job the one that expires last counts. An unknown, expired or foreign job gives the same error.
    """
    one = jobs.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in jobs.columns if c != "job_id"]), "expires_at").alias("_j")).select("job_id", "_j.*")
    joined = lookups.join(one, "job_id", "left")
    visible = F.coalesce(F.col("owner") == F.col("caller"), F.lit(False))
    if now is not None:
        visible = visible & (F.col("expires_at") > F.col(now))
    keep = lookups.columns
    shown = [F.when(visible, F.col(c)).alias(c) for c in ("status", "pages_total", "pages_completed")]
    return joined.select(*keep, F.when(visible, F.lit(200)).otherwise(F.lit(404)).alias("http_code"), *shown,
                         F.when(~visible, F.lit(JOB_NOT_FOUND)).alias("error"))


def live_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that have not expired."""
    return jobs.filter(F.col("expires_at") > now)


# ---- worker results ----------------------------------------------------------------------------


def extractor_chain(jobs: DataFrame, strategy_results: DataFrame, generic_results: DataFrame) -> DataFrame:
    """The strategy's result if it is registered and succeeded, else the generic one.

    ``jobs``: (job_id, requested). ``strategy_results``: (job_id, strategy, ok, page) for registered
    strategies. ``generic_results``: (job_id, ok, page).
    """
    best = F.max_by(F.struct("ok", "page"), "ok").alias("_r")  # a repeated result counts once, a success first
    tried = strategy_results.groupBy("job_id", F.col("strategy").alias("requested")).agg(best).select("job_id", "requested", F.col("_r.ok").alias("_s_ok"), F.col("_r.page").alias("_s_page"))
    plain = generic_results.groupBy("job_id").agg(best).select("job_id", F.col("_r.ok").alias("_g_ok"), F.col("_r.page").alias("_g_page"))
    joined = jobs.join(tried, ["job_id", "requested"], "left").join(plain, "job_id", "left")
    won = F.coalesce(F.col("_s_ok"), F.lit(False))
    return joined.select(
        "job_id",
        F.when(won, F.col("requested")).otherwise(F.lit(GENERIC)).alias("strategy"),
        F.when(F.col("_s_ok").isNotNull() & ~won, F.col("requested")).alias("fallback_from"),
        (won | F.coalesce(F.col("_g_ok"), F.lit(False))).alias("ok"),
        F.when(won, F.col("_s_page")).when(F.col("_g_ok"), F.col("_g_page")).alias("page"),
    )


def job_status_json(job_id: Column, ok: Column, data: Column) -> Column:
    """Status document of a one-page job: completed with one result, or failed with none."""
    result = F.struct(F.lit(True).alias("success"), data.alias("data"))
    # A conditional over structs would make the fields nullable; filter the one-element array instead.
    results = F.filter(F.array(result), lambda _: ok)
    status = F.struct(
        job_id.alias("job_id"),
        F.when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.lit(1).alias("pages_total"),
        F.when(ok, F.lit(1)).otherwise(F.lit(0)).alias("pages_completed"),
        results.alias("results"),
    )
    return F.to_json(status)


def result_data(content: Column, markdown: Column, title: Column, description: Column, language: Column, status: Column, strategy: Column | None = None, fallback: Column | None = None) -> Column:
    """The data part; missing texts are written as "" and an unset ``fallback_from`` is left out."""
    text = lambda c: F.coalesce(c, F.lit(""))
    meta = [
        text(title).alias("title"),
        text(description).alias("description"),
        text(language).alias("language"),
        status.cast("int").alias("status_code"),
    ]
    if strategy is not None:
        meta += [strategy.alias("strategy"), fallback.alias("fallback_from")]
    return F.struct(text(content).alias("content"), text(markdown).alias("markdown"), F.struct(*meta).alias("metadata"))


def store_results(results: DataFrame) -> DataFrame:
    """Materialize results before their entries are acknowledged."""
    return cut_lineage(results)
