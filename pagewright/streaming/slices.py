"""Sequential rules over ordered events, cut into time slices so that no key has to fit in one task.

A rule like a token bucket depends on all earlier events of its key. Each (key, time slice) is reduced
to a small summary of what it does to the state; short passes per key over the summaries give every
slice its exact starting state; then all slices run in parallel. Slices are cut by each key's own rows, so a
key with a third of all rows only has more slices, and a burst of one key cuts no other and no other time finer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.session import write_through

ROWS_PER_SLICE = 200_000
MICROS = 1_000_000
CELLS = (60 * MICROS, MICROS, 10_000, 100, 1)  # lengths of the cells whose rows are counted, each a part of the one before


def coded(key) -> Column:
    """A key as text that is never NULL, so that NULL is a key like any other in joins and in Python."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def decoded(key: str, kind: str) -> Column:
    """The key that ``coded`` wrote, in its own type."""
    return F.when(F.col(key) != "", F.substring(F.col(key), F.lit(2), F.length(key)).cast(kind))


def _cell(ts_us: str, length: int) -> Column:
    return F.expr(f"{ts_us} - pmod({ts_us}, {length})")


def count_slices(events: DataFrame, key: str, ts_us: str) -> dict[int, DataFrame]:
    """(key, cell, slice) by length of the cells: neighbouring cells of a key with fewer than twice ``ROWS_PER_SLICE`` rows are one
    slice, numbered by the start of its first cell. Only cells with more than ``ROWS_PER_SLICE`` rows are counted in finer ones.

    A running sum over a key's cells, which are no more than its minutes and a few hundred for each full slice. Rows of
    one microsecond stay together.
    """
    rows, leaves = events.select(F.col(key).alias("key"), F.col(ts_us).alias("_at")), {}
    for length in CELLS:
        counts = write_through(rows.groupBy("key", _cell("_at", length).alias("cell")).agg(F.count("*").alias("n")))
        dense = F.col("n") > (ROWS_PER_SLICE if length > 1 else 1 << 62)
        leaves[length] = counts.filter(~dense).withColumn("length", F.lit(length))
        full = counts.filter(dense)
        if full.isEmpty():
            break
        rows = rows.withColumn("cell", _cell("_at", length)).join(full.select("key", "cell"), ["key", "cell"], "leftsemi").drop("cell")
    cells = None
    for leaf in leaves.values():
        cells = leaf if cells is None else cells.unionByName(leaf)
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.withColumn("_sum", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_block", F.expr(f"_sum div {ROWS_PER_SLICE}"))
    placed = write_through(blocks.select("key", "cell", "length", F.min("cell").over(Window.partitionBy("key", "_block")).alias("slice")))
    return {length: placed.filter(F.col("length") == length).drop("length") for length in leaves}


def cut_slices(events: DataFrame, key: str, ts_us: str, order: str, extra: list[str], micros: int | None = None) -> DataFrame:
    """(key, slice, ts, order, extra...) with parallel arrays, sorted by time and then by ``order``.

    Slices last ``micros``, or are cut by their rows if that is None.
    """
    fields = [F.col(ts_us).alias("ts"), F.col(order).alias("id"), *[F.col(e) for e in extra]]
    rows = events.select(F.col(key).alias("key"), F.col(ts_us).alias("_at"), F.struct(*fields).alias("_f"))
    if micros is not None:
        placed = rows.withColumn("slice", F.expr(f"_at div {micros}"))
    else:
        placed = None
        for length, cells in count_slices(events, key, ts_us).items():  # each row lies in one cell of one length
            part = rows.withColumn("cell", _cell("_at", length)).join(cells, ["key", "cell"]).drop("cell")
            placed = part if placed is None else placed.unionByName(part)
    sorted_rows = placed.groupBy("key", "slice").agg(F.sort_array(F.collect_list("_f")).alias("_r"))
    pick = lambda name: F.transform("_r", lambda r: r[name]).alias(name)
    return sorted_rows.select("key", "slice", pick("ts"), pick("id"), *[pick(e) for e in extra])


def ordered_blocks(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_block``: ranges of their order by key and ``order``, stored. A key's blocks are numbered in its order,
    and a key with a third of all rows fills a third of the ranges."""
    ranged = rows.repartitionByRange(key, *order)
    return write_through(ranged.withColumn("_block", F.spark_partition_id()))


def per_slice(slices: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Run ``fn(row) -> dict`` on every slice, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fn(row) for row in batch.itertuples(index=False)])

    return slices.mapInPandas(run, schema)


def scan_summaries(summaries: DataFrame, fn: Callable[[Iterable[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``fn(summaries in slice order) -> dicts`` once per key.

    Summaries stream through in sorted batches and ``fn`` keeps a few numbers between them, so no task holds all of a key.
    """
    ordered = summaries.repartition("key").sortWithinPartitions("key", "slice")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.to_dict("records"))
        outs = ({"key": key, **out} for key, group in groupby(rows, itemgetter("key")) for out in fn(group))
        while some := list(islice(outs, 10_000)):
            yield pd.DataFrame(some)

    return ordered.mapInPandas(run, schema)
