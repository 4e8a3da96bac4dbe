"""Spelling variants: words one edit apart, found by signatures that partition and enumerate their letters."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as S

from pagewright.session import write_through

RUN = r"[a-zÀ-ÿ]"
SLIP = 199
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Parts of a letter vector. Two vectors that differ in at most two places agree on all parts but two.
PARTS = 8
#: Letters by how often European languages use them, so that the parts get like shares; a fixed value.
FREQUENT = "enaitsroludcmphgvfbqjkyzwx"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = SLIP, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of ``min_chars`` code points or more with ``min_count`` occurrences or more in all whole texts.

    Words are maximal runs ``[A-Za-z and U+00C0 to U+00FF]+``, A-Z lower-cased. If ``slip`` divides the checksum h of
    ``<id>:<run>``, the run loses its code point h % length, in all its occurrences in that document. NULL text has no
    words, a NULL id is empty in the checksum; repeated rows count each. Counts are added up per task before they move.
    """

    def count(batches):
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa

        runs = re.compile(f"{RUN}{{{min_chars},}}+")
        for batch in batches:
            total = Counter()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{key}:".encode())
                # Bytes are lower-cased in ASCII only.
                for run, n in Counter(runs.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    if slip and not (h := zlib.crc32(run.encode(), start)) % slip:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_chars:
                            continue
                    total[run] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    own = docs.filter(S.col(f"`{text_col}`").isNotNull()).select(S.coalesce(S.col(f"`{id_col}`").cast("string"), S.lit("")), S.col(f"`{text_col}`"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(S.sum("n").alias("n")).filter(S.col("n") >= min_count)


def letter_classes(words: DataFrame) -> DataFrame:
    """(letters, words): the words of each multiset of letters, in order; ``letters`` has the letters sorted.

    Words of one class are never one edit apart, as an edit changes the multiset.
    """
    letters = S.concat_ws("", S.array_sort(S.split("word", "")))
    return words.select(letters.alias("letters"), "word").groupBy("letters").agg(S.array_sort(S.collect_list("word")).alias("words"))


def signatures(classes: DataFrame, parts: int = PARTS) -> DataFrame:
    """(sig, ha, hb, only_a, only_b, size, letters, words): PartEnum signatures of letter multisets.

    A multiset is a binary vector with a place for each letter and occurrence (the first e, the second e, ...). Its
    places are dealt to ``parts`` parts. Vectors that differ in at most two places differ in at most two parts, so they
    agree on all others, for some pair of parts left out: a signature is such a pair and the sums of hashes of the
    other parts. ``ha`` and ``hb`` are the hashes of the two left out, ``only_a`` says that this is the pair that
    stands for vectors that differ in the first part only (then ``hb`` agrees), ``only_b`` likewise.
    """
    pairs = list(combinations(range(parts), 2))

    def enumerate_parts(batches):
        import numpy as np
        import pyarrow as pa

        def mixed(x):
            x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        order = np.arange(1 << 9, dtype=np.int64)
        order[[ord(c) for c in FREQUENT]] = range(len(FREQUENT))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                texts = batch.column(0).to_pylist()
                size = np.array([len(t) for t in texts])
                row = np.repeat(np.arange(len(texts)), size)
                code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
                # Letters are sorted, so an occurrence's number is its distance from the start of its run.
                new = np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])] if len(code) else np.zeros(0, dtype=bool)
                nth = np.arange(len(code)) - np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
                part = (order[code] + 3 * nth) % parts
                sums = np.zeros((len(texts), parts), dtype=np.uint64)
                np.add.at(sums, (row, part), mixed(((code << 32) + nth).astype(np.uint64)))
                total = sums.sum(axis=1, dtype=np.uint64)
                cols = [
                    [(total - sums[:, a] - sums[:, b]) ^ mixed(np.uint64([a * parts + b]))[0], sums[:, a], sums[:, b], np.full(len(texts), (a, b) == (0, 1)), np.full(len(texts), a == 0)]
                    for a, b in pairs
                ]
                sig, ha, hb, only_a, only_b = (np.concatenate(c) for c in zip(*cols))
                every = pa.array(np.tile(np.arange(len(texts)), len(pairs)))
                arrays = [pa.array(x.view(np.int64)) for x in (sig, ha, hb)] + [pa.array(only_a), pa.array(only_b), pa.array(np.tile(size, len(pairs)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*arrays, batch.column(0).take(every), batch.column(1).take(every)], ["sig", "ha", "hb", "only_a", "only_b", "size", "letters", "words"])

    return classes.mapInArrow(enumerate_parts, "sig long, ha long, hb long, only_a boolean, only_b boolean, size int, letters string, words array<string>")


def close_classes(sigs: DataFrame) -> DataFrame:
    """(a, b, a_words, b_words): classes that share a signature and may be at most two places apart, each pair once.

    Parts that are left out may differ in one or both; pairs that differ in both share this signature only, and pairs that
    differ in one are kept at the one signature that stands for it. Sizes differ by one at most. ``a`` is not the longer one.
    """
    left, right = sigs.alias("a"), sigs.alias("b")
    apart = (S.col("a.ha") != S.col("b.ha")), (S.col("a.hb") != S.col("b.hb"))
    once = (apart[0] & apart[1]) | (apart[0] & S.col("a.only_a")) | (apart[1] & S.col("a.only_b"))
    ordered = (S.col("a.size") + 1 == S.col("b.size")) | ((S.col("a.size") == S.col("b.size")) & (S.col("a.letters") < S.col("b.letters")))
    joined = left.join(right, (S.col("a.sig") == S.col("b.sig")) & ordered & once)
    return joined.select(S.col("a.letters").alias("a"), S.col("b.letters").alias("b"), S.col("a.words").alias("a_words"), S.col("b.words").alias("b_words"))


def near_words(classes: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of words that differ by one inserted, deleted or replaced code point.

    Pairs of classes are verified: the letters that only one of them has are told first; with one such letter, or one on
    each side, the words that are equal without it and, on both sides, have it at the same place are near.
    """

    def verify(batches):
        from collections import defaultdict

        import pyarrow as pa

        def extra(x: str, y: str) -> str:
            """The letters of a sorted text that a second one lacks."""
            for c in y:
                x = x.replace(c, "", 1)
            return x

        def without(words: list[str], letter: str, placed: bool):
            for w in words:
                at = w.find(letter)
                while at >= 0:
                    yield (w[:at] + "\0" * placed + w[at + 1 :]), w
                    at = w.find(letter, at + 1)

        for batch in batches:
            found = []
            for a, b, a_words, b_words in zip(*(c.to_pylist() for c in batch.columns)):
                more = extra(b, a)
                if len(more) != 1:
                    continue
                if len(b) > len(a):
                    known = set(a_words)
                    pairs = {(w, short) for short, w in without(b_words, more, False) if short in known}
                else:
                    less = extra(a, b)
                    rests = defaultdict(set)
                    for rest, w in without(a_words, less, True):
                        rests[rest].add(w)
                    pairs = {(w, x) for rest, w in without(b_words, more, True) for x in rests.get(rest, ())}
                found += pairs
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found] + [p[1] for p in found], pa.string()), pa.array([p[1] for p in found] + [p[0] for p in found], pa.string())], ["word", "near"])

    return close_classes(write_through(signatures(classes))).mapInArrow(verify, "word string, near string")


def follow_forms(words: DataFrame, top: int, ratio: int = RATIO) -> DataFrame:
    """``words`` with ``root``: the last word on the way along ``form``, the word itself without one.

    Counts grow by ``ratio`` (2 or more) at each step, so a way has at most the logarithm of the greatest count as steps; each round
    of jumps doubles the steps taken.
    """
    steps, reach = 0, 1
    while top >= ratio**steps:
        steps += 1
    ways = write_through(words.filter("form IS NOT NULL").select("word", S.col("form").alias("root")))
    while reach < steps:
        onward = ways.select(S.col("word").alias("_from"), S.col("root").alias("_to"))
        ways = write_through(ways.join(onward, ways["root"] == onward["_from"], "left").select("word", S.coalesce("_to", "root").alias("root")))
        reach *= 2
    return words.join(ways, "word", "left").withColumn("root", S.coalesce("root", "word"))


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, **rule) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of ``word_counts`` with its form.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of the
    largest count (of equal ones the first in code-point order), if that count is ``ratio`` times the word's own or more, else
    NULL. ``root`` is the last word on the way along forms. Words without near words have ``n_near`` 0. Empty tables and
    tables without words give no rows; further columns are not read.
    """
    words = write_through(word_counts(docs, id_col, text_col, **rule))
    # Both sides of this join are words, once each beside their near words; adaptive execution splits a hot one.
    pairs = near_words(write_through(letter_classes(words)))
    named = pairs.join(words.withColumnsRenamed({"word": "near", "n": "near_n"}), "near")
    best = S.min(S.struct((-S.col("near_n")).alias("m"), "near")).alias("best")
    found = named.groupBy("word").agg(S.count(S.lit(1)).alias("n_near"), best)
    near_n = -S.col("best.m")
    chosen = near_n >= ratio * S.col("n")
    out = words.join(found, "word", "left").select(
        "word", S.when(chosen, S.col("best.near")).alias("form"), "n", S.coalesce("n_near", S.lit(0).cast("long")).alias("n_near"), S.when(chosen, near_n).alias("form_n")
    )
    out = write_through(out)
    return follow_forms(out, out.agg(S.max("n")).first()[0] or 0, ratio)
