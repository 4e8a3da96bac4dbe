"""Token-bucket rate limit per key (G5-G7): exact batch form and streaming form.

Integer arithmetic: a token is 60,000,000 units, time is in microseconds, so a bucket with ``rate``
requests per minute refills ``rate`` units per microsecond and holds ``rate`` tokens.

Batch form. Let x be the true content of a bucket and L the content of one that pays a whole token for
denied requests too (never below zero). Then x - L is always less than one token, and

* L changes by steps "add, then clamp to a range", which compose to a step of the same kind, so a slice
  is summarized by three numbers;
* given L, the rest d = x - L changes only by "d = (d + L) mod token" where L could not pay and
  "d = min(d, capacity - L)" close to a full bucket. Seen on a circle of one token, both keep the order of
  values, so a slice maps an interval of rests to the interval between the images of its ends.

The rest at a slice's start is first known to lie anywhere. Each round tells every slice's images of a few
hundred points of its interval; one scan per key then bounds the rest at every start by two of them. The
intervals shrink by that factor from round to round, and at least one more slice of a key becomes exact in
each. No summary grows with the rows of its slice. The slices then decide their requests from the exact x.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewright.session import cut_lineage, write_through
from pagewright.streaming.slices import ordered_blocks, coded, cut_slices, decoded, per_slice, scan_summaries

TOKEN = 60_000_000
FULL_AFTER = 60_000_000  # microseconds in which any bucket refills completely
IDLE_TIMEOUT_MS = 5 * 60 * 1000
POINTS = 256  # of a slice's interval of rests whose images one round tells
_UNBOUNDED = 1 << 62


def refill(tokens: int, elapsed: int, rate: int, token: int = TOKEN, full_after: int = FULL_AFTER) -> int:
    return min(rate * token, tokens + rate * min(elapsed, full_after))


def decide(tokens: int, last: int | None, ts, rate, token: int = TOKEN, full_after: int = FULL_AFTER) -> tuple[int, list[bool], list[int]]:
    """Run requests in order from a bucket content; returns the content, decisions and remaining tokens."""
    allowed, remaining = [], []
    for t, r in zip(ts, rate):
        t, r = int(t), int(r)
        tokens = r * token if last is None else refill(tokens, t - last, r, token, full_after)
        last = t
        ok = tokens >= token
        if ok:
            tokens -= token
        allowed.append(ok)
        remaining.append(tokens // token if ok else 0)
    return tokens, allowed, remaining


def clamp_summary(row, token: int, full_after: int) -> dict:
    """Effect of a slice on L, from just after the refill at its first request."""
    shift, low, high, last = 0, 0, _UNBOUNDED, None
    for t, r in zip(row.ts, row.rate):
        t, r = int(t), int(r)
        if last is not None:
            gain, cap = r * min(t - last, full_after), r * token
            shift, low, high = shift + gain, min(low + gain, cap), min(high + gain, cap)
        shift, low, high = shift - token, max(low - token, 0), max(high - token, 0)
        last = t
    return {
        "key": row.key, "slice": row.slice, "first_ts": int(row.ts[0]), "last_ts": int(row.ts[-1]), "first_rate": int(row.rate[0]),
        "shift": shift, "low": low, "high": high,
    }


def scan_lower(summaries: Iterable[dict], token: int, full_after: int) -> Iterator[dict]:
    """L after the refill at the first request of every slice."""
    level, last = None, None
    for s in summaries:
        level = s["first_rate"] * token if last is None else refill(level, s["first_ts"] - last, s["first_rate"], token, full_after)
        yield {"slice": s["slice"], "lower": level, "opens": last is None}
        level = min(s["high"], max(s["low"], level + s["shift"]))
        last = s["last_ts"]


def rest_steps(row, token: int, full_after: int) -> Iterator[int]:
    """What a slice does to d: a number >= 0 rotates d, a number -1-m caps d at m."""
    level, last = int(row.lower), None
    for t, r in zip(row.ts, row.rate):
        t, r = int(t), int(r)
        if last is not None:
            level = refill(level, t - last, r, token, full_after)
        last = t
        room = r * token - level
        if room < token:
            yield -1 - room
        if level >= token:
            level -= token
        else:
            yield level
            level = 0


def rest_images(row, token: int, full_after: int, points: int = POINTS) -> dict:
    """Images of evenly spaced points of the interval (lo, hi) of rests under a slice, on the line that winds
    around the circle of one token; their order is the points'."""
    lo, hi = int(row.lo), int(row.hi)
    n = min(points, hi - lo)
    at = [lo + (hi - lo) * i // n for i in range(n + 1)] if n else [lo]
    y, group, steps = np.array(at, dtype=np.int64), np.arange(len(at)), 0
    for step in rest_steps(row, token, full_after):
        if step >= 0:
            y += step
        else:
            np.minimum(y, y // token * token - 1 - step, out=y)
            steps += 1
            if steps % 64 == 0 and len(y) > 1:  # points that met stay together
                y, same = np.unique(y, return_inverse=True)
                group = same[group]
    return {"key": row.key, "slice": row.slice, "lo": lo, "hi": hi, "points": at, "images": y[group].tolist()}


def scan_rests(summaries: Iterable[dict], token: int) -> Iterator[dict]:
    """Interval of the rest at the start of every slice, from that of the first, by the images of the last round."""
    low, high = 0, 0
    for s in summaries:
        if high - low >= token - 1:
            low, high = 0, token - 1
        yield {"slice": s["slice"], "lo": low, "hi": high}
        # The points cover the interval; a turn of the circle further, images are a token higher.
        turn, below = divmod(low - s["lo"], token)
        first = bisect_right(s["points"], s["lo"] + below) - 1
        image_low = int(s["images"][first]) + turn * token
        turn, below = divmod(high - s["lo"], token)
        last = bisect_left(s["points"], s["lo"] + below)
        image_high = int(s["images"][last] if last < len(s["points"]) else s["images"][0] + token) + turn * token
        base = image_low // token * token
        low, high = image_low - base, image_high - base


def decide_slice(row, token: int, full_after: int) -> dict:
    # The content after the first refill is known, so the first request sees no elapsed time.
    cap = int(row.rate[0]) * token
    start = min(cap, int(row.lower) + int(row.lo))
    _, allowed, remaining = decide(start, int(row.ts[0]), row.ts, row.rate, token, full_after)
    return {"key": row.key, "slice": row.slice, "ts": row.ts, "id": row.id, "allowed": allowed, "remaining": remaining}


def slice_decisions(events: DataFrame, slice_length: int | None, token: int = TOKEN, full_after: int = FULL_AFTER, points: int = POINTS) -> DataFrame:
    """(key, slice, ts, id, allowed, remaining) with parallel arrays, from events (key, _us, _id, rate)."""
    slices = cut_lineage(cut_slices(events, "key", "_us", "_id", ["rate"], slice_length))
    clamps = per_slice(
        slices.select("key", "slice", "ts", "rate"),
        lambda row: clamp_summary(row, token, full_after),
        "key string, slice long, first_ts long, last_ts long, first_rate long, shift long, low long, high long",
    )
    lower = scan_summaries(clamps, lambda s: scan_lower(s, token, full_after), "key string, slice long, lower long, opens boolean")
    entry = F.when(F.col("opens"), F.lit(0)).otherwise(F.lit(token - 1)).cast("long")
    starts = write_through(lower.select("key", "slice", "lower", F.lit(0).cast("long").alias("lo"), entry.alias("hi")))
    while not starts.filter("lo < hi").isEmpty():
        # Keys that are exact throughout rest.
        open_keys = write_through(starts.filter("lo < hi").select("key").distinct())
        images = per_slice(
            slices.select("key", "slice", "ts", "rate").join(starts.join(open_keys, "key"), ["key", "slice"]),
            lambda row: rest_images(row, token, full_after, points),
            "key string, slice long, lo long, hi long, points array<long>, images array<long>",
        )
        bounds = scan_summaries(images, lambda s: scan_rests(s, token), "key string, slice long, lo long, hi long")
        news = bounds.select("key", "slice", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        starts = write_through(starts.join(news, ["key", "slice"], "left").select("key", "slice", "lower", F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_hi", "hi").alias("hi")))
    return per_slice(
        slices.join(starts, ["key", "slice"]),
        lambda row: decide_slice(row, token, full_after),
        "key string, slice long, ts array<long>, id array<long>, allowed array<boolean>, remaining array<long>",
    )


def _calm_keys(events: DataFrame) -> DataFrame:
    """(key, calm): whether a key can never be limited, as no two neighbouring minutes hold more requests than its rate.

    Then no 60 seconds do, and a bucket that refills in 60 seconds never runs dry. Works on counts per minute.
    """
    minute = F.expr("_us div 60000000")
    counts = events.groupBy("key", minute.alias("m")).agg(F.count("*").alias("n"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    before = Window.partitionBy("key").orderBy("m").rangeBetween(-1, 0)
    pairs = counts.withColumn("pair", F.sum("n").over(before))
    return pairs.groupBy("key").agg(((F.max("pair") <= F.min("low")) & (F.min("low") == F.max("high"))).alias("calm"))


def _calm_decisions(events: DataFrame) -> DataFrame:
    """Decisions for keys that are never limited: only the remaining tokens are wanted, a running minimum.

    With y the content before request i (from 1) is paid, y - rate * time + TOKEN * i is the least of
    capacity - rate * time + TOKEN * j over all requests j up to i. A scan in two levels: minima inside blocks
    of the ordered requests, the count and minimum of each block carried on, then both put together; a key of any size falls
    into as many blocks as it fills.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    line = lambda n: wide(F.col("rate")) * wide(F.col("_us")) - wide(F.lit(TOKEN)) * wide(n)
    full = wide(F.col("rate") * TOKEN)
    blocks = Window.partitionBy("key", "_block").orderBy("_us", "_id")
    rows = ordered_blocks(events, "key", ["_us", "_id"]).withColumn("_n", F.row_number().over(blocks)).withColumn("_low", wide(full - line(F.col("_n"))))
    rows = rows.withColumn("_low", F.min("_low").over(blocks.rowsBetween(Window.unboundedPreceding, 0)))
    sums = write_through(rows.groupBy("key", "_block").agg(F.max("_n").cast("long").alias("_rows"), F.min("_low").alias("_least")))
    before = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("_least", wide(F.col("_least") + F.lit(TOKEN) * wide(F.col("_before"))))
    carried = write_through(carried.select("key", "_block", "_before", F.min("_least").over(before).alias("_carry")))
    placed = rows.join(carried, ["key", "_block"])
    least = F.least(F.col("_carry"), wide(F.col("_low") + F.lit(TOKEN) * wide(F.col("_before"))))
    left = F.floor((least + wide(line(F.col("_before") + F.col("_n"))) - TOKEN) / TOKEN).cast("long")
    return placed.select("key", "_us", "_id", F.lit(True).alias("allowed"), left.alias("remaining"))


def _sliced_decisions(events: DataFrame, slice_length: int | None) -> DataFrame:
    decided = slice_decisions(events, slice_length)
    rows = decided.select("key", F.explode(F.arrays_zip("ts", "id", "allowed", "remaining")).alias("r"))
    return rows.select("key", F.col("r.ts").alias("_us"), F.col("r.id").alias("_id"), "r.allowed", "r.remaining")


def limit_requests(requests: DataFrame, key: str, ts: str, request_id: str, rate, slice_length: int | None = None) -> DataFrame:
    """G5 over a request table: (key, ts, request_id, allowed, remaining), exact for any skew.

    Requests of a key are taken in order of time and then id. ``rate`` is a column of requests per minute; keys are
    text or whole numbers. NULL is a key like any other. A request without time, rate or id takes no token and gets no
    decision (NULL). Keys that can never be limited are decided in plain columns; the others slice by slice.
    """
    key_type = requests.schema[key].dataType.simpleString()
    coded_rows = requests.select(
        coded(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(request_id).cast("long").alias("_id"), rate.cast("long").alias("rate")
    )
    whole = F.col("_us").isNotNull() & F.col("rate").isNotNull() & F.col("_id").isNotNull()
    events = coded_rows.filter(whole)
    flagged = cut_lineage(events.join(write_through(_calm_keys(events)), "key"))
    none = coded_rows.filter(~whole).select("key", "_us", "_id", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("long").alias("remaining"))
    decided = _calm_decisions(flagged.filter("calm")).unionByName(_sliced_decisions(flagged.filter("NOT calm"), slice_length)).unionByName(none)
    return decided.select(decoded("key", key_type).alias(key), F.timestamp_micros("_us").alias(ts), F.col("_id").alias(request_id), "allowed", "remaining")


def limit_stream(requests: DataFrame, key: str, ts: str, request_id: str, rate: str) -> DataFrame:
    """G5, G7 on a stream: bucket contents are keyed state, dropped after five idle minutes (a bucket idle
    for one minute is full again). Requests are put in order inside each micro-batch, whose size the
    source's trigger limit bounds."""
    key_type = requests.schema[key].dataType.simpleString()
    rows = requests.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(request_id).cast("long").alias("id"), F.col(rate).cast("long").alias("rate"))

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(batches).sort_values(["ts", "id"])
        tokens, last = state.get if state.exists else (0, None)
        tokens, allowed, remaining = decide(tokens, last, batch["ts"], batch["rate"])
        state.update((tokens, int(batch["ts"].iloc[-1])))
        state.setTimeoutDuration(IDLE_TIMEOUT_MS)
        yield pd.DataFrame({"key": k[0], "ts": batch["ts"].values, "id": batch["id"].values, "allowed": allowed, "remaining": remaining})

    limited = rows.groupBy("key").applyInPandasWithState(
        step,
        f"key {key_type}, ts long, id long, allowed boolean, remaining long",
        "tokens long, last long",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    return limited.select(F.col("key").alias(key), F.timestamp_micros("ts").alias(ts), F.col("id").alias(request_id), "allowed", "remaining")
