"""Jaccard self-join on word shingles through groups of similar documents and their token unions.

Linked documents share at least ``overlap(n)`` shingles, so each misses at most ``n - overlap(n)`` of its own. Every
document therefore names its lowest shingles by hash, ``head(n)`` of them, and any two linked documents have at
least ``shared(n)`` of these in common. Documents whose heads are not that much shared take no further part. The others
name the rarest shared shingles of their heads, one of which every partner names, too; documents with a common
name are put into groups of bounded size. Within a group components are found by exact intersections. A document
then meets the other groups that hold one of its names: it is compared with a group's union of tokens first, and
only groups that hold enough of it are opened and intersected member by member. Where two groups may meet, the
smaller component asks the larger, and one link per pair of components is enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as S

from pagewright.functions.sql import fn as F
from pagewright.session import write_through

WORDS, PERCENT = 5, 80
HEAD_PERCENT = 15  # of a document's shingles, added to its head beyond what a link may miss
BUCKET_TOKENS = 1 << 16  # head shingles counted together
GROUP_DOCS, GROUP_TOKENS = 96, 1 << 19  # a group's members, and about their shingles
BLOCK_BYTES = 1 << 21  # text hashed at once
TOKEN_BYTES = 6


# ---- sizes ---------------------------------------------------------------------------------------


def overlap(n, percent: int):
    """Least intersection with any linked document, for a set of n shingles (numbers or numpy arrays)."""
    return -(-n * percent // 100)


def extra(n):
    return 1 + n * HEAD_PERCENT // 100


def head(n, percent: int):
    """Shingles of a set's head: what a link may miss, and ``extra`` more."""
    return n - overlap(n, percent) + extra(n)


def shared_sql(n: str, percent: int) -> str:
    """Least number of shingles that the heads of linked sets share; partners are no smaller than the overlap."""
    return f"(1 + ((({n} * {percent} + 99) div 100) * {HEAD_PERCENT}) div 100)"


# ---- shingles of texts, in numpy -----------------------------------------------------------------


def mix(x):
    """Bits of 64-bit numbers spread over each other."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS: dict = {}


def word_hashes(data, starts):
    """(hash, text number) of every word in bytes that hold texts beginning at ``starts``.

    A word's hash is a polynomial of its bytes, A-Z lower-cased, with 64-bit wrap-around, then mixed with its length.
    """
    import numpy as np

    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    values[space] = 0
    base = 0x9E3779B97F4A7C15
    blank = space[data]
    fresh = np.ones(n, bool)
    fresh[1:] = blank[:-1]
    fresh[starts[starts < n]] = True
    first = np.flatnonzero(fresh & ~blank)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(POWERS.get(base, ())) < n:  # kept for the task
        POWERS[base] = np.cumprod(np.full(n, base, np.uint64))
        POWERS[-base] = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    sums = np.add.reduceat(values[data] * POWERS[base][:n], first) * POWERS[-base][first]
    lengths = np.add.reduceat((~blank).astype(np.uint64), first)
    return mix(sums + lengths * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, first, side="right") - 1


def text_words(column):
    """(hash, text number) of all words of an Arrow string column, in blocks of about BLOCK_BYTES cut between words."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32 if column.type == "string" else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    hashes, owners = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    space = (32, 9, 10, 11, 12, 13)
    while at < end:
        cut = min(at + BLOCK_BYTES, end)
        while cut < end and data[cut] not in space:
            cut += 1
        low = int(np.searchsorted(offsets, at, side="right")) - 1
        high = int(np.searchsorted(offsets, cut, side="left"))
        h, o = word_hashes(data[at:cut], np.maximum(offsets[low:high] - at, 0))
        hashes.append(h)
        owners.append(o + low)
        at = cut
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(column, k: int):
    """(shingles, bounds): the distinct k-word shingles of each text as ascending 64-bit hashes, text after text.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    import numpy as np

    h, owner = text_words(column)
    count = np.bincount(owner, minlength=len(column))
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(h)
    if n >= k:
        rolled = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            rolled = mix(rolled * np.uint64(0xFF51AFD7ED558CCD) + h[j : n - k + 1 + j])
        whole = owner[: n - k + 1] == owner[k - 1 :]
        sets, own = rolled[whole], owner[: n - k + 1][whole]
    else:
        sets, own = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        more = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.array([count[d]], np.uint64)
            for w in h[first[d] : first[d + 1]]:
                x = mix(x * np.uint64(0xFF51AFD7ED558CCD) + w)
            more[i] = x[0]
        sets, own = np.concatenate([sets, more]), np.concatenate([own, short])
    order = np.lexsort((sets, own))
    sets, own = sets[order], own[order]
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (own[1:] != own[:-1])
    sets, own = sets[new], own[new]
    return sets, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(column)))])


def small_batches(batches, text: str = "text"):
    """The batches cut into rows with about BLOCK_BYTES of text, one row at least."""
    import numpy as np

    for batch in batches:
        column = batch[text]
        offsets = np.frombuffer(column.buffers()[1], np.int32 if column.type == "string" else np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + BLOCK_BYTES, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def fingerprints(sets, bounds):
    """Two 64-bit sums per set that tell sets apart."""
    import numpy as np

    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)))])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
    return out


def binary_runs(values, bounds):
    """Arrow binary column: the bytes of ``values`` (a row of bytes each) between bounds."""
    import numpy as np
    import pyarrow as pa

    width = values.dtype.itemsize if values.ndim == 1 else values.shape[1]
    offsets = pa.py_buffer((np.asarray(bounds) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def set_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, body, n, f1, f2, head) of every row of (id, body, text): set size, fingerprints, the lowest shingles' upper six bytes."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}["id"]

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches):
            sets, bounds = shingle_sets(batch["text"], k)
            n = np.diff(bounds)
            f1, f2 = fingerprints(sets, bounds)
            size = np.minimum(head(n, percent), n)
            inside = np.arange(len(sets)) - np.repeat(bounds[:-1], n) < np.repeat(size, n)
            low = sets[inside].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES :]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["body"], pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), binary_runs(low, np.concatenate([[0], np.cumsum(size)]))],
                ["id", "body", "n", "f1", "f2", "head"],
            )

    return docs.mapInArrow(rows, f"id {kind}, body long, n long, f1 long, f2 long, head binary")


# ---- shared heads ----------------------------------------------------------------------------------


def tokens_of(binary):
    """Six-byte tokens as 64-bit numbers."""
    import numpy as np

    raw = np.frombuffer(binary, np.uint8).reshape(-1, TOKEN_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :TOKEN_BYTES] = raw
    return wide.view("<u8")[:, 0]


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(sid, token, df): the head tokens that two or more sets have, with their number of sets.

    Tokens travel in blobs by a hash bucket; the number of buckets follows from the number of tokens, so a bucket
    holds about BUCKET_TOKENS of them, and any token at most once per set.
    """
    total = sets.agg(S.sum(S.octet_length("head"))).first()[0] or 0
    buckets = int(total) // TOKEN_BYTES // BUCKET_TOKENS + 1

    def spread(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            heads = batch["head"].to_pylist()
            raw = b"".join(heads)
            tokens = tokens_of(raw)
            sids = np.repeat(batch["sid"].to_numpy(), [len(h) // TOKEN_BYTES for h in heads])
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
            base = int(sids.min()) if len(sids) else 0
            wide = len(sids) and int(sids.max()) - base >= 1 << 32
            off = (sids[order] - base).astype("<u8" if wide else "<u4")
            used = np.flatnonzero(np.diff(bounds))
            raw = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)[order]
            cuts = np.concatenate([bounds[used], bounds[-1:]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), pa.array(np.full(len(used), base), pa.int64()), binary_runs(off, cuts), binary_runs(raw, cuts)], ["bucket", "base", "sids", "tokens"]
            )

    def count(table):
        import numpy as np
        import pyarrow as pa

        tokens, sids = [], []
        for row in table.to_pylist():
            tokens.append(tokens_of(row["tokens"]))
            wide = len(row["sids"]) == 8 * len(tokens[-1])
            sids.append(np.frombuffer(row["sids"], "<u8" if wide else "<u4").astype(np.int64) + row["base"])
        tokens, sids = np.concatenate(tokens), np.concatenate(sids)
        _, at, df = np.unique(tokens, return_inverse=True, return_counts=True)
        many = df[at] > 1
        return pa.table({"sid": pa.array(sids[many], pa.int64()), "token": pa.array(tokens[many].astype(np.int64)), "df": pa.array(df[at][many], pa.int64())})

    blobs = sets.select("sid", "head").mapInArrow(spread, "bucket long, base long, sids binary, tokens binary")
    return blobs.groupBy("bucket").applyInArrow(count, "sid long, token long, df long")


def names(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, n, token, count): the rare shared head tokens that stand for each set whose head is shared enough.

    Of the tokens of a head that ``shared`` must be in common, all but ``shared - 1`` hold one of them; the rarest
    are taken, by the same order for all sets. Tokens that only one such set names are left out.
    """
    least = S.expr(shared_sql("n", percent))
    lists = shared_tokens(sets).groupBy("sid").agg(S.array_sort(S.collect_list(S.struct("df", "token"))).alias("t"))
    lists = lists.join(sets.select("sid", "n"), "sid").filter(S.size("t") >= least)
    named = write_through(lists.select("sid", "n", S.explode(S.slice("t", S.lit(1), (S.size("t") - least + 1).cast("int"))).alias("x")).select("sid", "n", "x.token"))
    often = write_through(named.groupBy("token").agg(S.count(S.lit(1)).alias("count")).filter("count > 1"))
    return write_through(named.join(often, "token"))


# ---- groups ----------------------------------------------------------------------------------------


def incidence(binaries):
    """Members' shingle sets as (distinct tokens, token number of every entry, bounds)."""
    import numpy as np

    sets = [np.frombuffer(b, "<u8") for b in binaries]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    union, at = np.unique(np.concatenate(sets), return_inverse=True)
    return union, at, bounds


def linked(both, a, b, percent: int):
    return 100 * both >= percent * (a + b - both)


def group_components(sids, binaries, percent: int):
    """Component label (smallest sid) of each member of a group, by exact intersections.

    One member after the other is intersected with all that no component has reached yet.
    """
    import numpy as np

    order = np.argsort(sids, kind="stable")
    union, at, bounds = incidence([binaries[i] for i in order])
    sizes, n = np.diff(bounds), len(order)
    labels, waiting = np.full(n, -1), np.ones(n, bool)
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed], labels[seed] = False, seed
        queue = [seed]
        while queue and waiting.any():
            p = queue.pop()
            mark = np.zeros(len(union), np.int64)
            mark[at[bounds[p] : bounds[p + 1]]] = 1
            both = np.add.reduceat(mark[at], bounds[:-1])
            near = np.flatnonzero(waiting & linked(both, sizes, sizes[p], percent))
            waiting[near], labels[near] = False, seed
            queue += near.tolist()
    out = np.empty(n, np.int64)
    out[order] = np.asarray(sids)[order][labels]
    return out


def open_groups(queries, members, percent: int):
    """Yields (label of a query, label of a member's component) for every linked pair of components, once per query.

    A query is first counted against the union of the group's tokens: below its least overlap the group stays closed.
    """
    import numpy as np

    union, at, bounds = incidence(members["set"])
    sizes, labels = np.diff(bounds), np.asarray(members["label"])
    for label, binary in zip(queries["label"], queries["set"]):
        q = np.frombuffer(binary, "<u8")
        place = np.searchsorted(union, q)
        place = place[(place < len(union)) & (union[np.minimum(place, len(union) - 1)] == q)]
        if len(place) < overlap(len(q), percent):
            continue
        mark = np.zeros(len(union), np.int64)
        mark[place] = 1
        both = np.add.reduceat(mark[at], bounds[:-1])
        for other in np.unique(labels[linked(both, sizes, len(q), percent)]):
            if other != label:
                yield int(label), int(other)


def grouped(named: DataFrame) -> DataFrame:
    """(sid, gid): every named set's group: sets with the same most frequent name and like size, cut by a hash into chunks of bounded size."""
    best = named.groupBy("sid", "n").agg(S.max(S.struct("count", "token")).alias("b"))
    scale = S.ceil(S.log2(S.col("n").cast("double"))).cast("int")
    weight = S.greatest(S.ceil(S.col("b.count") / GROUP_DOCS), S.ceil(S.col("b.count") * S.pow(S.lit(2.0), scale) / GROUP_TOKENS)).cast("long")
    return best.select("sid", S.xxhash64("b.token", scale, S.pmod(S.xxhash64("sid"), weight)).alias("gid"))


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sid, set): the shingles of the wanted sets (sid, rep, f1, f2), from the text of one document that has it."""
    texts = docs.join(wanted.select("sid", "rep", "f1", "f2"), docs["id"] == S.col("rep")).select("sid", "f1", "f2", "text")

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches):
            sets, bounds = shingle_sets(batch["text"], k)
            f1, f2 = fingerprints(sets, bounds)
            same = (f1 == batch["f1"].to_numpy()) & (f2 == batch["f2"].to_numpy())
            out = pa.RecordBatch.from_arrays([batch["sid"], binary_runs(sets.astype("<u8"), bounds)], ["sid", "set"])
            yield out.filter(pa.array(same))

    return texts.mapInArrow(rows, "sid long, set binary").groupBy("sid").agg(S.first("set").alias("set"))


def component_edges(named: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels of components of different groups that a link joins.

    ``members`` has sid, gid, label, size (of the component) and set. A set asks the groups that share a name with it and
    hold a component larger than its own, in the order of size, then label; so of two components one asks.
    """
    rank = S.struct("size", "label")
    tops = members.groupBy("gid").agg(S.max(rank).alias("top"))
    held = named.select("sid", "token").join(members.select("sid", "gid"), "sid").select("token", "gid").distinct().join(tops, "gid")
    # A token's groups in lists of about 64.
    per = held.groupBy("token").agg(S.count(S.lit(1)).alias("_k")).filter("_k > 1")
    lists = held.join(write_through(per), "token").withColumn("_part", S.pmod(S.xxhash64("gid"), S.ceil(S.col("_k") / 64)))
    lists = write_through(lists.groupBy("token", "_part").agg(S.collect_list(S.struct("top", "gid")).alias("groups")).drop("_part"))
    asks = named.select("sid", "n", "token").join(members.select("sid", S.col("gid").alias("own"), rank.alias("mine")), "sid")
    asks = write_through(asks).join(lists, "token").select("sid", "n", S.expr("transform(filter(groups, g -> g.top > mine AND g.gid <> own), g -> g.gid)").alias("gids")).filter("size(gids) > 0")
    pairs = write_through(asks.groupBy("sid", "n").agg(S.array_distinct(S.flatten(S.collect_list("gids"))).alias("gids")).select("sid", "n", S.explode("gids").alias("gid")))
    # Queries come in parts of bounded number and size.
    parts = pairs.groupBy("gid").agg(S.greatest(S.ceil(S.count(S.lit(1)) / GROUP_DOCS), S.ceil(S.sum("n") / GROUP_TOKENS)).alias("_p"))
    dealt = pairs.join(write_through(parts), "gid").select("sid", "gid", S.pmod(S.xxhash64("sid"), S.col("_p")).alias("part"))
    queries = dealt.join(members.select("sid", "label", "set"), "sid").select(*[S.col(c).alias(c) for c in ("gid", "part", "label", "set")])
    wanted = dealt.select("gid", "part").distinct()
    opened = members.join(wanted, "gid").select(*[S.col(c).alias(c) for c in ("gid", "part", "label", "set")])

    def meet(key, asking, group):
        import pyarrow as pa

        found = sorted(set(open_groups(asking.to_pydict(), group.to_pydict(), percent))) if asking.num_rows and group.num_rows else []
        return pa.table({"a": pa.array([e[0] for e in found], pa.int64()), "b": pa.array([e[1] for e in found], pa.int64())})

    return queries.groupBy("gid", "part").cogroup(opened.groupBy("gid", "part")).applyInArrow(meet, "a long, b long").distinct()


# ---- components ------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) can reach.

    Alternates between linking every larger neighbour to a node's smallest and every smaller one, until nothing
    changes; each round is written to the shared folder. Rounds grow with the logarithm of the graph.
    """
    edges = write_through(edges.filter("a <> b").select(S.greatest("a", "b").alias("a"), S.least("a", "b").alias("b")).distinct())
    if edges.isEmpty():
        return edges.select(S.col("a").alias("node"), S.col("b").alias("root"))
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(S.col("b").alias("a"), S.col("a").alias("b")))
        low = write_through(both.groupBy("a").agg(S.least("a", S.min("b")).alias("m")))
        large = both.join(low, "a").filter("b > a").select(S.col("b").alias("a"), S.col("m").alias("b")).filter("a <> b").distinct()
        large = write_through(large)
        low = write_through(large.groupBy("a").agg(S.min("b").alias("m")))
        small = large.join(low, "a").select(S.col("b").alias("a"), S.col("m").alias("b")).unionByName(low.select("a", S.col("m").alias("b")))
        edges = write_through(small.filter("a <> b").distinct())
        new = edges.agg(S.count(S.lit(1)), S.sum(S.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(S.col("a").alias("node"), S.col("b").alias("root"))
        state = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, text_hash, n_shingles, component_id) for every row of ``docs``; text_hash is xxhash64 of the text, '' for NULL.

    A document's set holds its distinct shingles of ``words`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); with fewer
    words its whole sequence is the one shingle. Two documents link when 100 * intersection >= percent * union.
    component_id is the smallest id that links reach, the own included. No candidate is left out; shingles are told
    apart by 64 bits. NULL and empty texts have no shingles and link with nothing. Rows with a NULL id have their
    size but no component, and no link goes through them. Repeated rows and equal texts are one set; rows of
    one id with different texts are different documents. An empty table gives no rows; other columns are not read.
    """
    text = S.coalesce(S.col(f"`{text_col}`"), S.lit(""))
    own = docs.select(S.col(f"`{id_col}`").alias("id"), S.xxhash64(text).alias("body"), text.alias("text"))
    rows = write_through(set_rows(own, words, percent))
    distinct = rows.filter("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n").agg(S.min("id").alias("rep"), S.first("head").alias("head"))
    sets = write_through(distinct.withColumn("sid", S.monotonically_increasing_id()))
    named = names(sets, percent)
    groups = write_through(grouped(named))
    wanted = groups.join(sets.select("sid", "rep", "f1", "f2"), "sid")
    stored = write_through(full_sets(own, wanted, words).join(groups, "sid"))

    def inside(table):
        import pyarrow as pa

        labels = group_components(table["sid"].to_numpy(), table["set"].to_pylist(), percent)
        return pa.table({"sid": table["sid"], "label": pa.array(labels, pa.int64())})

    labels = write_through(stored.groupBy("gid").applyInArrow(inside, "sid long, label long"))
    sizes = labels.groupBy("label").agg(S.count(S.lit(1)).alias("size"))
    members = write_through(stored.join(labels.join(write_through(sizes), "label"), "sid"))
    roots = write_through(components(component_edges(named, members, percent)))
    placed = labels.join(roots, labels["label"] == roots["node"], "left").select("sid", S.coalesce("root", "label").alias("root"))
    placed = placed.join(sets.select("sid", "rep"), "sid")
    least = write_through(placed.groupBy("root").agg(S.min("rep").alias("component_id")))
    found = write_through(placed.join(least, "root").select("sid", "component_id"))
    known = sets.join(found, "sid", "left").select("f1", "f2", S.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("id", "body", "n", "f1", "f2").join(write_through(known), ["f1", "f2"], "left")
    component = S.when(S.col("id").isNull(), S.lit(None)).when(S.col("n") == 0, S.col("id")).otherwise(S.col("component_id"))
    return out.select(S.col("id").alias(id_col), S.col("body").alias("text_hash"), S.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component of ``near_duplicates`` stays, that with the smallest id; of repeated rows one.

    Rows with a NULL id have no component and stay. Of rows with one id and different texts, those stay whose own
    component has that id. The text moves once, by id.
    """
    first = near_duplicates(docs, id_col, text_col, words, percent).filter(S.col(id_col) == S.col("component_id"))
    first = first.select(S.col(id_col).alias("first"), S.col("text_hash").alias("body")).distinct()
    hashed = docs.select(S.struct("*").alias("row"), S.col(f"`{id_col}`").alias("id"), S.xxhash64(S.coalesce(S.col(f"`{text_col}`"), S.lit(""))).alias("own"))
    kept = hashed.join(first, (S.col("id") == S.col("first")) & (S.col("own") == S.col("body")), "left_semi").dropDuplicates(["id", "own"])
    return kept.unionByName(hashed.filter("id IS NULL")).select("row.*")
