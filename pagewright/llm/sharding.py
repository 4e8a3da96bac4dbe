"""Shards cut from a Hilbert curve through several metadata dimensions. Native columns only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as S

from pagewright.session import write_through

BITS = 5
BINS = 4096


def hilbert_index(df: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """Column ``name``: the place of the cell (axes, each 0 to 2^bits - 1) on the Hilbert curve.

    The transposition of coordinates is a fixed number of bit operations per row, in plain columns.
    """
    x = [f"_x{i}" for i in range(len(axes))]
    df = df.withColumns({c: S.col(a).cast("int") for c, a in zip(x, axes)})
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        for c in x:
            on = S.col(c).bitwiseAND(q) != 0
            if c == x[0]:
                df = df.withColumns({c: S.when(on, S.col(c).bitwiseXOR(q - 1)).otherwise(S.col(c))})
                continue
            swap = S.col(x[0]).bitwiseXOR(S.col(c)).bitwiseAND(q - 1)
            df = df.withColumns({
                x[0]: S.when(on, S.col(x[0]).bitwiseXOR(q - 1)).otherwise(S.col(x[0]).bitwiseXOR(swap)),
                c: S.when(on, S.col(c)).otherwise(S.col(c).bitwiseXOR(swap)),
            })
    for a, b in zip(x, x[1:]):
        df = df.withColumns({b: S.col(b).bitwiseXOR(S.col(a))})
    fix = S.lit(0)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        fix = fix.bitwiseXOR(S.when(S.col(x[-1]).bitwiseAND(q) != 0, q - 1).otherwise(0))
    df = df.withColumn("_fix", fix).withColumns({c: S.col(c).bitwiseXOR(S.col("_fix")) for c in x})
    parts = [
        S.shiftleft(S.shiftright(S.col(c), b).bitwiseAND(1).cast("long"), b * len(x) + len(x) - 1 - i)
        for b in range(bits) for i, c in enumerate(x)
    ]
    return df.withColumn(name, reduce(lambda a, b: a.bitwiseOR(b), parts)).drop("_fix", *x)


def category(c: Column) -> Column:
    """A dimension of names: (bin, value that orders the bin)."""
    text = S.coalesce(c.cast("string"), S.lit(""))
    return S.struct(S.pmod(S.xxhash64(text), S.lit(BINS)).cast("int").alias("bin"), text.alias("low"))


def magnitude(c: Column) -> Column:
    """A dimension of sizes in steps of an eighth of a doubling; NULL and values under 1 share the first bin."""
    # The small addend keeps exact powers of two on their step, however the logarithm is rounded.
    step = S.least(S.floor(S.log2(S.greatest(S.coalesce(c, S.lit(0)), S.lit(1)).cast("double")) * 8 + 1e-9), S.lit(BINS - 1)).cast("int")
    return S.struct(step.alias("bin"), S.lpad(step.cast("string"), 8, "0").alias("low"))


def cell_codes(rows: DataFrame, dims: list[str], bits: int) -> list[DataFrame]:
    """For each dimension a table (bin, code) of at most ``BINS`` rows: equal numbers of rows get equal ranges of codes."""
    codes = []
    for d in dims:
        bins = rows.groupBy(S.col(f"{d}.bin").alias("bin")).agg(S.count(S.lit(1)).alias("n"), S.min(f"{d}.low").alias("low"))
        w = Window.orderBy("low", "bin")  # at most BINS rows
        before, total = S.sum("n").over(w) - S.col("n"), S.sum("n").over(Window.partitionBy())
        codes.append(bins.select("bin", before.alias("before"), total.alias("total")).select("bin", S.floor(S.col("before") * (1 << bits) / S.col("total")).cast("int").alias("code")))
    return codes


def curve_order(rows: DataFrame, dims: list[str], ties: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve`` (the Hilbert index of its quantised dimensions), ``rank`` (gapless from 0 along the
    curve, ties by the columns ``ties``, then any order among equal rows) and ``total``.

    Ranges of the curve are sorted apart from each other, and only their row counts meet in one place, so no
    task holds more than a range, however many rows a cell has.
    """
    rows = write_through(rows.withColumn("_row", S.monotonically_increasing_id()))
    placed = rows
    for d, codes in zip(dims, cell_codes(rows, dims, bits)):
        codes = codes.select(S.col("bin").alias("_bin"), S.col("code").alias(f"_c_{d}"))
        placed = placed.join(S.broadcast(codes), S.col(f"{d}.bin") == S.col("_bin")).drop("_bin")  # at most BINS rows
    placed = hilbert_index(placed, [f"_c_{d}" for d in dims], bits, "curve").drop(*[f"_c_{d}" for d in dims])
    order = ["curve", *ties, "_row"]
    ranged = write_through(placed.repartitionByRange(*order).withColumn("_range", S.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(S.count(S.lit(1)).alias("_n"))
    w = Window.orderBy("_range")  # one row per range
    starts = counts.select("_range", (S.sum("_n").over(w) - S.col("_n")).alias("_start"), S.sum("_n").over(Window.partitionBy()).alias("total"))
    here = S.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    ranked = ranged.withColumn("_here", here).join(S.broadcast(starts), "_range")  # one row per range
    return ranked.withColumn("rank", S.col("_here") + S.col("_start")).drop("_range", "_row", "_here", "_start")


def hilbert_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """(id, size, text_crc32, names, curve, shard, slot): runs of the Hilbert curve through the given names and the text's size.

    Row counts of any two shards differ by one at most; neighbours on the curve share languages, sources and sizes,
    so a reader prunes shards by any of them. NULL text has size 8 and checksum 0; NULL names count as empty names;
    NULL ids and repeated rows are rows like any other. An empty table gives no rows. No text is moved. Equal texts are no
    group of their own under this law: they lie where language, source, size and then id put them.
    """
    size = S.coalesce(S.octet_length(text_col), S.lit(0)).cast("long") + 8
    crc = S.crc32(S.coalesce(S.col(text_col), S.lit("")).cast("binary"))
    rows = docs.select(S.col(id_col).alias("_id"), size.alias("size"), crc.alias("text_crc32"), *[S.col(n).cast("string").alias(f"n_{n}") for n in names])
    dims = [f"d_{n}" for n in names] + ["d_size"]
    rows = rows.withColumns({f"d_{n}": category(S.col(f"n_{n}")) for n in names} | {"d_size": magnitude(S.col("size"))})
    ranked = curve_order(rows, dims, ["_id", "size", "text_crc32"], bits)
    shard = S.expr(f"rank * {shards} div total").cast("int")
    cut = ranked.withColumn("shard", shard).withColumn("slot", S.expr(f"rank - (shard * total + {shards - 1}) div {shards}"))
    return cut.select(S.col("_id").alias(id_col), "size", "text_crc32", *[S.col(f"n_{n}").alias(n) for n in names], "curve", "shard", "slot")
