"""Best-fit packing of texts into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as S

from pagewright.functions.sql import fn as F
from pagewright.session import write_through

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces packed together. More of them waste less; a shard ends with a few bins that its own pieces can't fill.
SHARD_PIECES = 4096


def sequence_cost(capacity: int) -> float:
    """Cost of one sequence: a fixed part, one per token and the square that attention adds."""
    return 64 + capacity + capacity * capacity / 65536


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (descending, none over the largest capacity), and each bin's capacity.

    Each piece goes to the open bin with the least room that holds it, the oldest of equal ones. If there is none,
    a bin opens whose size costs least per token: each size is filled in thought, longest fitting piece first, with
    the pieces still to come, and priced as the smallest capacity that holds that; the smaller of equal ones. At
    the end each bin shrinks to the smallest capacity that holds its contents.
    """
    sizes = sorted(capacities)
    room: list[tuple[int, int]] = []  # (room, bin) of the open bins
    used: list[int] = []
    bins, offsets = [], []
    rising = [-n for n in lengths]

    def price(size: int, i: int) -> tuple[float, int]:
        fill = lengths[i]
        while (i := bisect_left(rising, fill - size, i + 1)) < len(lengths):
            fill += lengths[i]
        return cost(next(c for c in sizes if c >= fill)) / fill, size

    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            space = min((c for c in sizes if c >= n), key=lambda c: price(c, i))
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if space > n:
            insort(room, (space - n, b))
    return bins, offsets, [next(c for c in sizes if c >= u) for u in used]


def pack_rows(rows: DataFrame, keys: list[str], length_col: str, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = sequence_cost, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(keys, piece, start, length, bin_id, capacity, offset): where each piece of each row goes.

    A row longer than the largest capacity is cut into pieces of that length and a rest; ``start`` counts from the
    row's first token. Rows of length 0 or NULL take no room: one piece with NULL bin, capacity and offset.
    Pieces are spread over shards by a hash of keys, length and the number of a copy among equal rows, so neither a key nor
    rows that repeat are hot, and each shard is packed by itself, longest first, ties by keys; the outcome depends on
    the rows alone. Repeated rows are packed each. Only keys and lengths move. An empty table gives no rows.
    """
    largest = max(capacities)
    own = rows.select(*[S.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], S.coalesce(S.col(f"`{length_col}`").cast("long"), S.lit(0)).alias("_n"))
    names = [f"_k{i}" for i in range(len(keys))]
    # Equal rows are counted, per task before they move, and numbered again in blocks.
    block = 1 << 16
    own = own.groupBy(*names, "_n").agg(S.count(S.lit(1)).alias("_copies")).select("*", S.explode(S.expr(f"sequence(0L, _copies - 1, {block}L)")).alias("_first"))
    own = own.select(*names, "_n", S.explode(S.expr(f"sequence(_first, least(_first + {block - 1}, _copies - 1))")).alias("_row"))
    pieces = own.select(*names, S.posexplode(F.sequence(0, F.greatest(F.col("_n") - 1, 0), largest).col).alias("piece", "start"), "_n", "_row")
    pieces = write_through(pieces.select(*names, "_row", "piece", "start", S.least(S.col("_n") - S.col("start"), S.lit(largest)).cast("int").alias("length")))
    shards = -(-pieces.count() // shard_pieces)
    shard = S.pmod(S.xxhash64(*names, "_row", "piece", "length"), S.lit(max(shards, 1)))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, "piece", "start", "length"]) + ", bin_id long, capacity int, offset int"

    def pack(table):
        import pyarrow as pa

        table = table.sort_by([("length", "descending"), *((n, "ascending") for n in names), ("piece", "ascending")])
        bins, offsets, sizes = best_fit(table["length"].to_pylist(), capacities, cost)
        first = table["_shard"][0].as_py() << 32
        table = table.drop_columns(["_shard", "_row"]).append_column("bin_id", pa.array([first + b for b in bins], pa.int64()))
        return table.append_column("capacity", pa.array([sizes[b] for b in bins], pa.int32())).append_column("offset", pa.array(offsets, pa.int32()))

    packed = pieces.filter("length > 0").withColumn("_shard", shard).groupBy("_shard").applyInArrow(pack, schema)
    empty = pieces.filter("length = 0").drop("_row").selectExpr("*", "CAST(NULL AS long) AS bin_id", "CAST(NULL AS int) AS capacity", "CAST(NULL AS int) AS offset")
    return packed.unionByName(empty).select(*[S.col(n).alias(k) for n, k in zip(names, keys)], "piece", "start", "length", "bin_id", "capacity", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``pack_rows`` over whole texts, a token being a word ``[^\\x20\\x09-\\x0D]+``."""
    words = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), ""), r"[^\x20\x09-\x0D]++")
    # The checksum tells texts apart where ids don't, so rows without an id are spread, too.
    rows = docs.select(S.col(f"`{id_col}`").alias("id"), S.crc32(S.coalesce(S.col(f"`{text_col}`"), S.lit("")).cast("binary")).alias("sum"), words.alias("n").col)
    return pack_rows(rows, ["id", "sum"], "n", **rule).drop("sum").withColumnRenamed("id", id_col)
