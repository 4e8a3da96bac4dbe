"""Queue and worker health (M1-M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewright.operators.rows import entry_order

# Monitored streams and the tier each serves.
STREAMS = {"scrape_jobs": "fast", "browser_jobs": "browser", "stealth_jobs": "stealth", "crawl_jobs": "crawl"}


def queue_health(entries: DataFrame, consumers: DataFrame, pending: DataFrame) -> DataFrame:
    """M1-M3: one row per monitored stream, empty streams included.

    ``entries``: (stream, ...). ``consumers``: (stream, grp, consumer, idle_ms).
    ``pending``: (stream, grp, entry_id, idle_ms). Every table is reduced to a few rows by partial
    aggregation before it is joined; the stream list is a fixed four rows.
    """
    streams = entries.sparkSession.createDataFrame(list(STREAMS.items()), "stream string, tier string")
    length = entries.groupBy("stream").agg(F.count("*").alias("length"))
    # A group's oldest entry is the one with the lowest id, as numbers, not the one idle longest.
    oldest = (
        pending.groupBy("stream", "grp")
        .agg(F.min_by("idle_ms", entry_order("entry_id")).alias("_idle"))
        .groupBy("stream")
        .agg(F.max("_idle").alias("oldest_pending_ms"))
    )
    per_consumer = consumers.groupBy("stream", "grp", "consumer").agg(F.min("idle_ms").alias("_idle"))
    active = per_consumer.groupBy("stream").agg(F.count("*").alias("consumers"), F.min("_idle").alias("idle_ms"))
    joined = F.broadcast(streams).join(length, "stream", "left").join(active, "stream", "left").join(oldest, "stream", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "stream",
        "tier",
        F.coalesce("length", zero).alias("length"),
        F.coalesce("consumers", zero).alias("consumers"),
        "oldest_pending_ms",
        "idle_ms",
    )


def overall_status(health: DataFrame, connected: bool = True) -> DataFrame:
    """M4: unhealthy without a connection, degraded without a fast consumer, else healthy."""
    fast = F.sum(F.when(F.col("tier") == "fast", F.col("consumers")))
    return health.agg(
        F.when(F.lit(not connected), F.lit("unhealthy")).when(F.coalesce(fast, F.lit(0)) == 0, F.lit("degraded")).otherwise(F.lit("healthy")).alias("status")
    )
