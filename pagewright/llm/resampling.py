"""Importance resampling of documents towards a target corpus, ranked by a distributed radix sort."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as S

from pagewright.session import write_through

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Words that are hashed together; bounds what a task holds besides the batch of texts it reads.
BLOCK_WORDS = 1 << 18
#: Words over this many bytes are hashed one by one.
LONG_WORD = 48
#: Bits of a digit of the sort at most, and bits of a position inside its block.
DIGIT_BITS, BLOCK_BITS = 10, 13


def _crc_table():
    import numpy as np

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def _crc_states(table, state, data, starts, lengths):
    """CRC states after the bytes of each word, from a state before each; all words move forward by one byte at a time."""
    import zlib

    import numpy as np

    order = np.argsort(lengths, kind="stable")[::-1]
    at, size, out = starts[order], lengths[order], state[order]
    left = np.searchsorted(-size, -np.arange(1, LONG_WORD + 1), side="right")  # words of more than 0, 1, 2, ... bytes
    giant = int(np.searchsorted(-size, -LONG_WORD, side="left"))
    for i in range(giant):
        out[i] = zlib.crc32(data[at[i] : at[i] + size[i]], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j, n in enumerate(left):
        if n <= giant:
            break
        s = out[giant:n]
        out[giant:n] = table[(s ^ data[at[giant:n] + j]) & 255] ^ (s >> 8)
    back = np.empty_like(out)
    back[order] = out
    return back


def feature_blocks(data, offsets, buckets: int) -> Iterator[tuple]:
    """(row, bucket, words) blocks of the features of texts that lie one after the other in an array of UTF-8 bytes.

    ``row`` and ``bucket`` are arrays with one entry a feature; ``words`` is the row of every word of the block. A
    word's state is its bytes' checksum on the way; a pair's goes on from there over a space and the next word.
    """
    import numpy as np

    kinds = np.zeros(256, dtype=bool)
    kinds[0x30:0x3A] = kinds[0x61:0x7B] = kinds[0x80:] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    table, data = _crc_table(), lower[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kinds[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # where one text ends and the next begins
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    for i in range(0, len(starts), BLOCK_WORDS):
        j = min(i + BLOCK_WORDS + 1, len(starts))  # one word more, for the pair that reaches into the next block
        at, size, row = starts[i:j], ends[i:j] - starts[i:j], rows[i:j]
        state = _crc_states(table, np.full(j - i, 0xFFFFFFFF, dtype=np.uint32), data, at, size)
        n = min(BLOCK_WORDS, j - i)
        same = np.flatnonzero(row[1:] == row[:-1])
        space = table[(state[same] ^ 32) & 255] ^ (state[same] >> 8)
        pair = _crc_states(table, space, data, at[same + 1], size[same + 1])
        sums = ~np.concatenate([state[:n], pair])
        yield np.concatenate([row[:n], row[same]]), (sums % np.uint32(buckets)).astype(np.int64), row[:n]


def _bytes_of(column):
    """Bytes and offsets of an Arrow array of strings without NULLs."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole is not None and whole.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all whole texts fall into each bucket that has any; counted per task before anything moves."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        seen = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket, _ in feature_blocks(*_bytes_of(batch.column(0)), buckets):
                seen += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    own = texts.select(S.coalesce(S.col(f"`{text_col}`"), S.lit("")).alias("t"))
    return own.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(S.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket in order: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))). One number a bucket comes to the driver."""
    spark = source.sparkSession
    every = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    rows = both.select("bucket", "s", "t").orderBy("bucket").collect()
    big_s, big_t = sum(r.s for r in rows), sum(r.t for r in rows)
    gain = S.expr(f"floor(1000 * ln(((t + 1D) * ({big_s}D + {buckets})) / ((s + 1D) * ({big_t}D + {buckets}))))").cast("long")
    counted = spark.createDataFrame([(r.bucket, r.s, r.t) for r in rows], "bucket long, s long, t long")
    return [r.gain for r in counted.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def score_texts(docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the floored mean of the gains of its features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def score(batches):
        import numpy as np
        import pyarrow as pa

        gain = np.array(shared.value, dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            words, features, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for row, bucket, word_rows in feature_blocks(*_bytes_of(batch.column(1)), len(gain)):
                words += np.bincount(word_rows, minlength=n)
                features += np.bincount(row, minlength=n)
                total += np.bincount(row, weights=gain[bucket], minlength=n).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    own = docs.select(S.col(f"`{id_col}`").alias("id"), S.coalesce(S.col(f"`{text_col}`"), S.lit("")).alias("t"))
    return own.mapInArrow(score, f"id {own.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel_noise(id_col: str, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the first 8 hex digits of sha256 of ``<seed>:<id>``; a NULL id is empty there."""
    text = f"concat('{seed}:', coalesce(CAST(`{id_col}` AS string), ''))"
    return S.expr(f"CAST(floor(-1000 * ln(-ln((CAST(conv(substring(sha2({text}, 256), 1, 8), 16, 10) AS long) + 0.5D) / 4294967296D))) AS long)")


def _digits(rows: DataFrame, keys: list[str]) -> list[Column]:
    """Digits of the composite key from the least to the most significant, as many as the keys' bits ask for.

    Keys are longs in ascending order, the first the most significant, NULL last. The bits above the highest one
    in which the least and the greatest key differ are the same everywhere and need no pass.
    """
    stats = [f(S.col(k)) for k in keys for f in (S.min, S.max)] + [S.count_if(S.col(k).isNull()) for k in keys]
    found = rows.agg(*[s.alias(f"x{i}") for i, s in enumerate(stats)]).first()
    out = []
    for i, k in reversed(list(enumerate(keys))):
        low, high = found[2 * i], found[2 * i + 1]
        bits = 0 if low is None else ((low ^ high) & ((1 << 64) - 1)).bit_length()
        passes = -(-bits // DIGIT_BITS)
        whole = S.coalesce(S.col(k).bitwiseXOR(S.lit(-(1 << 63))), S.lit(0).cast("long"))
        for p in range(passes):
            first, after = p * bits // passes, (p + 1) * bits // passes
            out.append(S.shiftrightunsigned(whole, first).bitwiseAND(S.lit((1 << (after - first)) - 1).cast("long")))
        if found[2 * len(keys) + i]:
            out.append(S.col(k).isNull().cast("long"))
    return out or [S.lit(0).cast("long")]


def radix_positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_pos``: the place of each row, from 0, in the order of its long ``keys`` (the first the most significant, NULL last).

    A least-significant-digit radix sort. Each pass is a stable counting sort on one digit: the rows stand in blocks of
    2^13 places; the rows of each digit are counted per block; prefix sums over (digit, block) give where the rows of
    a digit in a block go; a row's destination is that plus its rank there. No task holds more than a block's rows of a
    digit or, in the prefix sums, one number a block, so equal keys need no care. Each pass is written to the shared
    folder. Rows with equal keys keep the order in which they were stored. An empty table stays empty.
    """
    now = write_through(rows.withColumn("_pos", S.monotonically_increasing_id()))
    running = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    for digit in _digits(now, keys):
        dealt = now.withColumn("_digit", digit).withColumn("_block", S.shiftright("_pos", BLOCK_BITS))
        counts = write_through(dealt.groupBy("_digit", "_block").agg(S.count(S.lit(1)).alias("_n")))
        # At most 2^10 digits: their starts need no partitioning.
        totals = counts.groupBy("_digit").agg(S.sum("_n").alias("_n"))
        starts = totals.select("_digit", S.coalesce(S.sum("_n").over(Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), S.lit(0)).alias("_start"))
        before = counts.select("_digit", "_block", S.coalesce(S.sum("_n").over(running), S.lit(0)).alias("_before"))
        offsets = before.join(starts, "_digit").select("_digit", "_block", (S.col("_start") + S.col("_before")).alias("_offset"))
        rank = S.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_pos"))
        moved = dealt.withColumn("_rank", rank).join(offsets, ["_digit", "_block"])
        now = write_through(moved.withColumn("_pos", S.col("_offset") + S.col("_rank") - 1).select(*now.columns))
    return now


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank`` is 1, 2, 3, ... for the drawn ones, else NULL.

    Features are words ``[0-9a-z and all beyond ASCII]+`` of whole texts, A-Z lower-cased, and pairs of consecutive ones. A
    document's weight is the mean gain of its features' buckets; its score adds noise that follows from its id, so that the
    highest scores are a draw without replacement in proportion to the weights' exponentials. Of the documents with ``min_words``
    words, ``percent`` in a hundred are drawn, ties to smaller ids, NULL ids last; rows repeated exactly are drawn each. NULL and
    empty texts have no features and weight 0. An empty target gives every bucket the gain of its rarity alone; empty documents give
    no rows. Ids are whole numbers; further columns are not read.
    """
    gains = bucket_gains(feature_counts(docs, text_col, buckets), feature_counts(target, target_col, buckets), buckets)
    scored = score_texts(docs, gains, id_col, text_col).withColumn("score", S.col("weight") + gumbel_noise("id", seed))
    scored = write_through(scored)
    able = S.col("n_words") >= min_words
    n, top = scored.filter(able).agg(S.count(S.lit(1)), S.max("score")).first()
    ids = scored.schema["id"].dataType.simpleString()
    keyed = scored.filter(able).withColumn("_down", S.lit(top or 0).cast("long") - S.col("score")).withColumn("_id", S.col("id").cast("long"))
    placed = radix_positions(keyed, ["_down", "_id"])
    rank = S.when(S.col("_pos") < n * percent // 100, S.col("_pos") + 1)
    parts = [placed.withColumn("rank", rank), scored.filter(~able).withColumn("rank", S.lit(None).cast("long"))]
    columns = ["id", "n_words", "n_features", "weight", "score", "rank"]
    out = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    return out.withColumn("id", S.col("id").cast(ids)).withColumnRenamed("id", id_col)
