"""Acknowledged consumption of a job queue, and recovery of what was not acknowledged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.operators.jobs import CLAIM_BATCH, CLAIM_IDLE_MS, split_entries
from pagewright.operators.rows import entry_order
from pagewright.session import read_folder

STORED, ACKNOWLEDGED = "stored", "acknowledged"


class Ledger:
    """What has been done for each micro-batch: one small file a batch and step, written after the step's own rows.

    A step whose entry is missing is done anew, over whatever an earlier attempt left, so every step is done at least
    once and its rows stand once.
    """

    SCHEMA = "rows long, batch long, step string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def steps(self, batch: int) -> set[str]:
        return {r.step for r in read_folder(self.spark, self.path, self.SCHEMA).filter(F.col("batch") == batch).select("step").collect()}

    def done(self, step: str) -> DataFrame:
        """(batch) of all micro-batches that have been through a step."""
        return read_folder(self.spark, self.path, self.SCHEMA).filter(F.col("step") == step).select("batch").distinct()

    def enter(self, batch: int, step: str, rows: int) -> None:
        row = self.spark.createDataFrame([(rows,)], "rows long").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/batch={batch}/step={step}")


def consume_queue(entries: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, dialect: str = "fast", once: bool = True) -> StreamingQuery:
    """Read a queue, store results, then acknowledge.

    ``entries`` is a stream of (entry_id, fields, ...); ``work`` makes (job_id, ...) rows from usable ones (S5).
    ``path`` gets three folders: ``results`` and ``acks``, a sub-folder per micro-batch, and the ledger. Results are stored
    before their entries are acknowledged; malformed entries are acknowledged without a result, failed jobs have a
    result that says so. If a run dies between two steps, the stream gives the same micro-batch again, and the steps
    that the ledger lacks are done anew in place, so nothing is lost and nothing is counted twice.
    """

    def sink(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, f"{path}/ledger")
        steps = ledger.steps(number)
        if ACKNOWLEDGED in steps:
            return
        if STORED not in steps:
            usable, _ = split_entries(batch, dialect)
            work(usable).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
            ledger.enter(number, STORED, 0)
        batch.select("entry_id").write.mode("overwrite").parquet(f"{path}/acks/batch={number}")
        ledger.enter(number, ACKNOWLEDGED, batch.select("entry_id").count())

    writer = entries.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One result per job: of those stored by ``consume_queue``, the one of the latest micro-batch.

    Batches without a ledger entry are unfinished and not read. A job may have been delivered in several entries.
    """
    columns = [f.name for f in read_folder(spark, f"{path}/none", schema).schema if f.name != "job_id"]
    rows = read_folder(spark, f"{path}/results", f"{schema}, batch long").join(Ledger(spark, f"{path}/ledger").done(STORED), "batch")
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*columns), F.struct("batch", *columns)).alias("_r")).select("job_id", "_r.*")


def acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """(entry_id) that a run of ``consume_queue`` has acknowledged."""
    return read_folder(spark, f"{path}/acks", "entry_id string, batch long").join(Ledger(spark, f"{path}/ledger").done(ACKNOWLEDGED), "batch").select("entry_id").distinct()


# ---- orphans (S11) -----------------------------------------------------------------------------

WAITING, SETTLED = "waiting", "settled"


def idle_entries(log: DataFrame, idle_ms: int = CLAIM_IDLE_MS, event_time: str | None = None) -> DataFrame:
    """S11 as a stream: (stream, grp, entry_id, what): entries unacknowledged for ``idle_ms`` after their last delivery.

    ``log`` streams (stream, grp, entry_id, kind, ...), kind being ``deliver`` or ``ack``. Each entry is a state of its
    own, with a timer that its deliveries set anew and its acknowledgement ends, so no group's state is large. When the timer goes
    off the entry is ``waiting``; if it is acknowledged or delivered after that, it is ``settled``. Timers follow the clock; with
    ``event_time``, a timestamp column with a watermark, they follow the log, so that a replay gives the same rows.
    """
    us = F.unix_micros(event_time) if event_time else F.lit(0).cast("long")
    # Several rows of an entry in one micro-batch: the last one by time counts, an acknowledgement after a delivery of its time.
    rows = log.select("stream", "grp", "entry_id", "kind", us.alias("us"), *([event_time] if event_time else []))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def told(what: str) -> pd.DataFrame:
            return pd.DataFrame({"stream": [key[0]], "grp": [key[1]], "entry_id": [key[2]], "what": [what]})

        if state.hasTimedOut:
            state.update((-1, False))  # waiting: the timer has gone off
            yield told(WAITING)
            return
        due, acked = state.get if state.exists else (0, False)
        batch = pd.concat(batches)
        if acked:
            return
        # An entry is done with once it is acknowledged, and later deliveries of it are stale.
        if (batch["kind"] == "ack").any():
            state.update((0, True))
            if due < 0:
                yield told(SETTLED)
            return
        if due < 0:
            yield told(SETTLED)
        last = int(batch["us"].max())
        due = max(due, last + idle_ms * 1000)
        state.update((due, False))
        if event_time:
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(idle_ms)

    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("stream", "grp", "entry_id").applyInPandasWithState(step, "stream string, grp string, entry_id string, what string", "due long, acked boolean", "append", timeout)


CLAIMS = "stream string, grp string, entry_id string"


def claim_orphans(changes: DataFrame, path: str, checkpoint: str, consumer: str, limit: int = CLAIM_BATCH, once: bool = True) -> StreamingQuery:
    """Hand idle entries to a new consumer, the first ``limit`` of each group and micro-batch by id as numbers.

    ``changes`` is the stream of ``idle_entries``. ``path`` gets the claims (stream, grp, entry_id, consumer) and what still waits,
    a sub-folder per micro-batch each, with a ledger, so a batch that is given again makes the same claims. An entry is claimed once;
    it may wait again after it has been delivered anew.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ledger = Ledger(spark, f"{path}/ledger")
        if STORED in ledger.steps(number):
            return
        before = ledger.done(STORED).filter(F.col("batch") < number).agg(F.max("batch")).first()[0]
        held = read_folder(spark, f"{path}/waiting/batch={before}", CLAIMS)
        # Settled or taken entries leave; an entry of which both are told in a batch waits if that was told by its timer after.
        last = batch.groupBy("stream", "grp", "entry_id").agg(F.max(F.col("what") == SETTLED).alias("gone"))
        fresh = last.filter("NOT gone").select("stream", "grp", "entry_id")
        waiting = held.join(last.filter("gone"), ["stream", "grp", "entry_id"], "left_anti").union(fresh).distinct()
        order = Window.partitionBy("stream", "grp").orderBy(entry_order("entry_id"))
        ranked = waiting.withColumn("_n", F.row_number().over(order))
        taken = ranked.filter(F.col("_n") <= limit).drop("_n")
        taken.withColumn("consumer", F.lit(consumer)).write.mode("overwrite").parquet(f"{path}/claims/batch={number}")
        # The window's limit runs inside every task before the shuffle; the rest is what the claims lack.
        rest = waiting.join(spark.read.schema(CLAIMS).parquet(f"{path}/claims/batch={number}"), ["stream", "grp", "entry_id"], "left_anti")
        rest.write.mode("overwrite").parquet(f"{path}/waiting/batch={number}")
        ledger.enter(number, STORED, 0)

    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def claimed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, stream, grp, entry_id, consumer) of all claims made."""
    return read_folder(spark, f"{path}/claims", f"{CLAIMS}, consumer string, batch long").join(Ledger(spark, f"{path}/ledger").done(STORED), "batch")
