"""Exact top-k inner products with norm buckets and pruning per bucket."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as S

from pagewright.functions.sql import Expr, expr, fn as F
from pagewright.session import write_through

BUCKET_ROWS = 1024
QUERY_ROWS = 256
GROUP_BLOCKS = 64  # query blocks that meet a bucket at once
SALTS = 16
#: Pairs of a bucket and a query block that one task compares by their bounds, more or less.
TASK_PAIRS = 1 << 17
#: From this local cosine threshold on, a bucket is pruned by a coordinate, under it by length alone.
COORDINATE_FROM = 0.3
NO_ID = (1 << 63) - 1  # stands for a NULL id, which comes last among ties
SLACK = 1e-9  # on the side of keeping


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(_row, id, v, norm, dim): floor(scale * x) of every component; rows with NULL or non-finite parts are left out.

    ``_row`` tells rows with one id apart; it stays as this table is written.
    """
    v = expr(f"`{vec_col}`")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < Expr("double('Infinity')")), False))
    rows = df.filter((v.isNotNull() & sound).col).select(S.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * float(scale))).alias("v").col)
    square = F.aggregate(F.col("v"), Expr("0D"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return write_through(rows.select(S.monotonically_increasing_id().alias("_row"), "id", "v", S.sqrt(square.col).alias("norm"), S.size("v").alias("dim")))


def in_blocks(rows: DataFrame, order: list[Column], size: int) -> DataFrame:
    """(block, dim, low, high, rows, ids, norms, vectors): runs of at most ``size`` rows along ``order``.

    Rows of one dimension each; binary columns hold the runs' numbers. Ranges are cut by value, so equal norms
    or equal vectors spread over many.
    """

    def blocks(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims = batch["dim"].to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, z in zip(starts, starts[1:]):
                for at in range(a, z, size):
                    part = batch.slice(at, min(size, z - at))
                    n, dim = part.num_rows, int(dims[at])
                    ids = part["id"].fill_null(NO_ID).to_numpy().astype("<i8")
                    norms = part["norm"].to_numpy().astype("<f8")
                    vectors = np.asarray(part["v"].flatten().to_numpy(), dtype="<i8")
                    small = np.abs(vectors).max(initial=0) < 1 << 31
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array([dim], pa.int32()), "low": [float(norms.min())], "high": [float(norms.max())], "n": pa.array([n], pa.int32()),
                        "rows": pa.array([part["_row"].to_numpy().astype("<i8").tobytes()], pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary()),
                        "norms": pa.array([norms.tobytes()], pa.binary()), "vectors": pa.array([vectors.astype("<i4" if small else "<i8").tobytes()], pa.binary()),
                    })

    schema = "dim int, low double, high double, n int, rows binary, ids binary, norms binary, vectors binary"
    ranged = rows.repartitionByRange(S.col("dim"), *order, S.col("_row")).sortWithinPartitions(S.col("dim"), *order, S.col("_row"))
    return write_through(ranged.mapInArrow(blocks, schema).withColumn("block", S.monotonically_increasing_id()))


def unpack(row):
    """rows, ids, norms and the matrix of a block."""
    import numpy as np

    rows, ids, norms = (np.frombuffer(row[c], dtype=t) for c, t in (("rows", "<i8"), ("ids", "<i8"), ("norms", "<f8")))
    width = "<i4" if len(row["vectors"]) == 4 * len(rows) * row["dim"] else "<i8"
    return rows, ids, norms, np.frombuffer(row["vectors"], dtype=width).reshape(len(rows), row["dim"])


def products(a, b):
    """Exact inner products of the rows of two whole-number matrices, as int64, held to its range."""
    import numpy as np

    if not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_bucket(bucket, queries, floors, k: int):
    """Yields (query number, positions, scores): the k best rows of a bucket that reach a query's floor, its own row aside.

    ``floors`` are lower bounds of the scores that count. A row reaches one only if it is long enough, and, with
    the local cosine threshold t = floor / (|q| * longest row), only if its cosine to the query is t at least; so a
    coordinate of its direction lies in an interval around that of the query. What stays is multiplied out.
    """
    import numpy as np

    rows, ids, norms, vectors = bucket
    q_rows, _, q_norms, q_vectors = queries
    order = np.argsort(-norms, kind="stable")
    rows, ids, norms, vectors = rows[order], ids[order], norms[order], vectors[order]
    unit = vectors / np.maximum(norms, 1e-300)[:, None]
    longest = norms[0]
    for i in range(len(q_rows)):
        floor, length = floors[i], q_norms[i]
        keep = np.arange(len(rows))
        if np.isfinite(floor) and floor > 0:
            if length * longest * (1 + SLACK) < floor:
                continue
            keep = keep[: np.searchsorted(-norms, -(floor / length) * (1 - SLACK), side="right")]  # by length
            t = floor / (length * longest) - SLACK
            if t >= COORDINATE_FROM and len(keep):
                f = int(np.argmax(np.abs(q_vectors[i])))
                c = q_vectors[i][f] / length
                spread = math.sqrt(max(0.0, (1 - c * c) * (1 - t * t)))
                low = -1.0 if c <= -t else t * c - spread
                high = 1.0 if c >= t else t * c + spread
                x = unit[keep, f]
                keep = keep[(x >= low - SLACK) & (x <= high + SLACK)]
        keep = keep[rows[keep] != q_rows[i]]
        if not len(keep):
            continue
        scores = products(vectors[keep], q_vectors[i : i + 1])[:, 0]
        near = scores >= floor
        keep, scores = keep[near], scores[near]
        best = np.lexsort((rows[keep], ids[keep], -scores))[:k] if len(keep) > k else np.arange(len(keep))
        yield i, ids[keep[best]], scores[best]


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, for a cogroup with rows of the same origin."""
    return df.select(*[S.col(c).alias(c) for c in df.columns])


def top_inner_products(df: DataFrame, id_col: str, vec_col: str, is_query: str, k: int = 5, scale: int = 256, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for every query row the k other rows with the highest whole-number inner product.

    Components become floor(scale * x). ``is_query`` is a condition on column ``id``. Ties go to the smaller id, a
    NULL id last. Vectors that are NULL or hold NULL or non-finite components take no part; vectors of different
    dimensions don't meet; rows that repeat an id are rows of their own, and only the query's own row is left out.
    Fewer other rows than k give them all; an empty table gives no rows; other columns are not read.

    Rows lie in buckets along their norm. A first pass over the bucket with the longest rows gives each query a
    floor under its k-th best score; then every bucket that can reach a floor meets the queries, block by block,
    pruned by coordinate or by length. Per query and bucket at most k rows come back.
    """
    rows = whole_vectors(df, id_col, vec_col, scale)
    buckets = in_blocks(rows, [S.col("norm").desc(), S.col("id")], bucket_rows)
    queries = in_blocks(rows.filter(is_query), [S.col("id")], query_rows)
    n_queries = queries.count()
    parts = max(1, math.ceil(n_queries / GROUP_BLOCKS))
    salts = max(SALTS, math.ceil(buckets.count() * n_queries / TASK_PAIRS))
    queries = queries.withColumn("part", S.pmod(S.xxhash64("block"), S.lit(parts)).cast("int"))
    longest = buckets.groupBy("dim").agg(S.max_by(S.struct("block", "high"), S.struct(S.col("high"), -S.col("block"))).alias("b")).select("dim", S.col("b.block").alias("block"))

    def floors(key, bucket, blocks):
        import numpy as np
        import pyarrow as pa

        out = {"qblock": [], "floors": [], "tau": []}
        own = unpack(bucket.to_pylist()[0])
        for row in blocks.to_pylist():
            q = unpack({c[1:]: v for c, v in row.items() if c[0] == "q"} | {"dim": row["dim"]})
            low = np.full(len(q[0]), -np.inf)
            for i, _, scores in search_bucket(own, q, low.copy(), k):
                if len(scores) == k:
                    low[i] = np.nextafter(float(scores.min()), -np.inf)
            tau = np.where(q[2] > 0, low / np.maximum(q[2], 1e-300), -np.inf)
            out["qblock"].append(row["qblock"])
            out["floors"].append(low.astype("<f8").tobytes())
            out["tau"].append(float(tau.min(initial=np.inf)))
        return pa.table({"qblock": pa.array(out["qblock"], pa.int64()), "floors": pa.array(out["floors"], pa.binary()), "tau": pa.array(out["tau"], pa.float64())})

    named = queries.select("dim", "part", *[S.col(c).alias(f"q{c}") for c in ("block", "rows", "ids", "norms", "vectors")])
    first = buckets.join(longest, ["dim", "block"]).select("dim", "rows", "ids", "norms", "vectors")
    first = fresh(named.select("dim", "part").distinct().join(first, "dim"))
    bounds = first.groupBy("dim", "part").cogroup(named.groupBy("dim", "part")).applyInArrow(floors, "qblock long, floors binary, tau double")
    bounded = write_through(named.join(bounds, "qblock"))

    # Which query blocks a bucket meets is settled on narrow rows; equal dimensions are spread by as many salts as pairs ask for.
    salted = buckets.select("dim", "block", "high", S.pmod("block", S.lit(salts)).alias("salt"))
    spread = bounded.select("dim", "part", "qblock", "tau", S.explode(S.sequence(S.lit(0), S.lit(salts - 1)).cast("array<long>")).alias("salt"))
    meet = salted.join(spread, ["dim", "salt"]).filter(S.col("high") * (1 + SLACK) >= S.col("tau")).select("block", "part", "qblock")
    asked = meet.join(bounded.drop("dim"), ["qblock", "part"])
    offered = fresh(meet.select("block", "part").distinct().join(buckets, "block"))

    def search(key, bucket, blocks):
        import numpy as np
        import pyarrow as pa

        out = {"query": [], "id": [], "score": []}
        for b in bucket.to_pylist():
            own = unpack(b)
            for row in blocks.to_pylist():
                q = unpack({c[1:]: v for c, v in row.items() if c[0] == "q"} | {"dim": b["dim"]})
                for i, ids, scores in search_bucket(own, q, np.frombuffer(row["floors"], dtype="<f8"), k):
                    out["query"] += [int(q[0][i])] * len(ids)
                    out["id"] += ids.tolist()
                    out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    hits = offered.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search, "query long, id long, score long")
    rank = S.row_number().over(Window.partitionBy("query").orderBy(S.col("score").desc(), "id"))
    best = hits.withColumn("rank", rank).filter(S.col("rank") <= k)
    asker = rows.filter(is_query).select(S.col("_row").alias("query"), S.col("id").alias("query_id"))
    return best.join(asker, "query").select("query_id", "rank", S.when(S.col("id") != NO_ID, S.col("id")).alias(id_col), "score")
