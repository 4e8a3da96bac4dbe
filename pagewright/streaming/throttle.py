"""Throttled reject log per reason (G15): exact batch form and streaming form.

A line is written when at least the interval has passed since the last written line of its reason, and
it reports how many were held back since. That is a token bucket of one token that refills in the interval:
a line is written where a token is left. The counts then follow from one number per slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.session import cut_lineage
from pagewright.streaming.slices import MICROS, coded, decoded, per_slice, scan_summaries
from pagewright.streaming.token_bucket import slice_decisions

# Why a signed plan was refused.
REJECT_REASONS = ("bad_signature", "bad_timestamp", "stale_timestamp", "bad_owner", "bad_plan_encoding", "bad_plan_json")
INTERVAL_SECONDS = 10
_ALWAYS = -(1 << 62)


def _written(ts: np.ndarray, free: int, gap: int) -> list[int]:
    lines, i = [], int(np.searchsorted(ts, free))
    while i < len(ts):
        lines.append(i)
        i = max(i + 1, int(np.searchsorted(ts, ts[i] + gap)))
    return lines


def _edges(row) -> dict:
    """Whether a slice writes, and how many events come after its last line."""
    lines = np.flatnonzero(np.asarray(row.allowed, dtype=bool))
    return {"key": row.key, "slice": row.slice, "writes": bool(len(lines)), "after": len(row.allowed) - int(lines[-1]) - 1 if len(lines) else len(row.allowed)}


def _scan_held(summaries: Iterable[dict]) -> Iterator[dict]:
    held = 0
    for s in summaries:
        yield {"slice": s["slice"], "held": held}
        held = int(s["after"]) + (0 if s["writes"] else held)


def _mark(row) -> dict:
    emitted, suppressed = np.asarray(row.allowed, dtype=bool), [None] * len(row.ts)
    held, previous = int(row.held), -1
    for i in np.flatnonzero(emitted).tolist():
        suppressed[i] = held + i - previous - 1
        held, previous = 0, i
    return {"key": row.key, "ts": row.ts, "id": row.id, "emitted": emitted.tolist(), "suppressed": suppressed}


def throttle_log(events: DataFrame, reason: str, ts: str, event_id: str, interval_seconds: int = INTERVAL_SECONDS, slice_length: int | None = None) -> DataFrame:
    """G15 over an event table: (reason, ts, event_id, emitted, suppressed), suppressed only on written lines.

    NULL is a reason like any other. An event without time or id is never written and not counted: emitted is NULL.
    """
    gap, kind = interval_seconds * MICROS, events.schema[reason].dataType.simpleString()
    coded_rows = events.select(coded(reason).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(event_id).cast("long").alias("_id"))
    whole = F.col("_us").isNotNull() & F.col("_id").isNotNull()
    rows = coded_rows.filter(whole).withColumn("rate", F.lit(1).cast("long"))
    decided = cut_lineage(slice_decisions(rows, slice_length, token=gap, full_after=gap).drop("remaining"))
    edges = per_slice(decided.select("key", "slice", "allowed"), _edges, "key string, slice long, writes boolean, after long")
    held = scan_summaries(edges, _scan_held, "key string, slice long, held long")
    marked = per_slice(
        decided.join(held, ["key", "slice"]), _mark, "key string, ts array<long>, id array<long>, emitted array<boolean>, suppressed array<long>"
    )
    flat = marked.select("key", F.explode(F.arrays_zip("ts", "id", "emitted", "suppressed")).alias("r")).select("key", F.col("r.ts").alias("_us"), F.col("r.id").alias("_id"), "r.emitted", "r.suppressed")
    none = coded_rows.filter(~whole).select("key", "_us", "_id", F.lit(None).cast("boolean").alias("emitted"), F.lit(None).cast("long").alias("suppressed"))
    return flat.unionByName(none).select(decoded("key", kind).alias(reason), F.timestamp_micros("_us").alias(ts), F.col("_id").alias(event_id), "emitted", "suppressed")


def throttle_stream(events: DataFrame, reason: str, ts: str, event_id: str, interval_seconds: int = INTERVAL_SECONDS) -> DataFrame:
    """G15 on a stream: the last line and the number held back are keyed state."""
    gap = interval_seconds * MICROS
    rows = events.select(F.col(reason).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(event_id).cast("long").alias("id"))

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(batches).sort_values(["ts", "id"])
        free, held = state.get if state.exists else (_ALWAYS, 0)
        ts_array = batch["ts"].to_numpy("int64")
        lines, previous = _written(ts_array, free, gap), -1
        emitted, suppressed = np.zeros(len(ts_array), dtype=bool), [None] * len(ts_array)
        for i in lines:
            emitted[i], suppressed[i] = True, held + i - previous - 1
            held, previous = 0, i
        held += len(ts_array) - previous - 1
        state.update((int(ts_array[lines[-1]]) + gap if lines else free, held))
        yield pd.DataFrame({"key": k[0], "ts": ts_array, "id": batch["id"].values, "emitted": emitted, "suppressed": pd.array(suppressed, dtype="Int64")})

    marked = rows.groupBy("key").applyInPandasWithState(
        step, "key string, ts long, id long, emitted boolean, suppressed long", "free long, held long", "append", GroupStateTimeout.NoTimeout
    )
    return marked.select(F.col("key").alias(reason), F.timestamp_micros("ts").alias(ts), F.col("id").alias(event_id), "emitted", "suppressed")
