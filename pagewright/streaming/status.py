"""Job status as a stream of events kept as one row per job, until it expires."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators.jobs import lookup_jobs, upsert_status
from pagewright.session import write_through

BUCKETS = 64


def _bucket(job: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int")


def _rewrite(rows: DataFrame, path: str) -> None:
    """Replace the folders of the buckets that ``rows`` holds; the rows lie in the shared checkpoint folder before."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def maintain_status(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, now: Column | None = None) -> StreamingQuery:
    """Keep the latest status per job, in folders by a hash of the job.

    A micro-batch reads and rewrites the folders of its own jobs only, and what they held before is gone; what a run finds
    there is its initial state. A repeated batch changes nothing, so at-least-once delivery gives exactly one result. With
    ``now`` (an epoch in the unit of ``expires_at``, such as the clock), rows that have expired leave the folders that are rewritten: a
    job's status and its owner are one row and leave together. ``expire_status`` does the same for folders at rest.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", _bucket("job_id", buckets))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        try:
            current = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched))
        except AnalysisException:  # nothing written yet
            current = None
        merged = upsert_status(current, new)
        if now is None:
            _rewrite(write_through(merged), path)
        else:
            _replace(spark, write_through(merged.withColumn("_live", F.col("expires_at") > now)), path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """``_rewrite`` of the rows that are ``_live``. A folder left without rows keeps one of NULLs, as a folder that
    no row names would not be replaced."""
    live = rows.filter("_live").drop("_live")
    gone = rows.filter("NOT _live").select("bucket").distinct().join(live.select("bucket").distinct(), "bucket", "left_anti")
    blank = gone.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "bucket" else F.col("bucket") for f in live.schema])
    _rewrite(live.unionByName(blank), path)


def read_status(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """The stored status rows; with ``now``, those that have not expired. A row is gone at the instant it expires."""
    rows = spark.read.parquet(path).filter("job_id IS NOT NULL")
    return rows if now is None else rows.filter(F.col("expires_at") > now)


def expire_status(spark: SparkSession, path: str, now: Column) -> None:
    """Drop expired rows from all folders that hold any; the others are not rewritten."""
    rows = spark.read.parquet(path)
    expired = F.col("job_id").isNotNull() & (F.col("expires_at") <= now)
    touched = [r.bucket for r in rows.filter(expired).select("bucket").distinct().collect()]  # at most as many as folders
    if touched:
        held = rows.filter(F.col("bucket").isin(touched) & F.col("job_id").isNotNull())
        _replace(spark, write_through(held.withColumn("_live", ~expired)), path)


def lookup_status(lookups: DataFrame, path: str, now: str, buckets: int = BUCKETS) -> DataFrame:
    """S10, G9 over the stored rows: ``lookup_jobs`` for (job_id, caller, now). Folders that hold no job asked for are not read."""
    spark = lookups.sparkSession
    asked = [r.b for r in lookups.select(_bucket("job_id", buckets).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    return lookup_jobs(lookups, read_status(spark, path).filter(F.col("bucket").isin(asked)).drop("bucket"), now)
