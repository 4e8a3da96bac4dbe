"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, buckets=10_000):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return len(words), [zlib.crc32(x.encode()) % buckets for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target, percent=25, min_words=20, buckets=10_000, seed=7):
    """Rows (id, n_words, n_features, weight, score) and the drawn ids in order."""
    own = [(i, *features(t, buckets)) for i, t in docs]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for x in target for b in features(x, buckets)[1])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= min_words)
    return rows, [None if none else i for _, none, i in able][: len(able) * percent // 100]


def check(df, docs, target, **rule):
    rows, drawn = plain(docs, target, **rule)
    got = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()]
    assert sorted((g[:5] for g in got), key=repr) == sorted(rows, key=repr)
    ranked = sorted((g[5], g[0]) for g in got if g[5] is not None)
    assert [k for k, _ in ranked] == list(range(1, len(drawn) + 1)) and [i for _, i in ranked] == drawn


@pytest.fixture(scope="module")
def target(spark):
    texts = ["the cat sat on the mat", "Über die Brücke", None, "", "cat 42 cat"]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_rows_of_all_kinds(make_docs, target):
    random.seed(3)
    some = ["the", "cat", "Mat", "über", "42", "日本", "x" * 49, "y" * 47, "z" * 48, "a" * 70_000, "don't", "É"]
    docs = [(i, " ".join(random.choices(some[:8] + some[10:], k=random.randrange(60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \n.,!\x00"), (103, "one"), (104, " ".join(some * 3)), (105, "the cat " * 40_000), (None, "the cat sat " * 9), (-7, "mat " * 30), (-7, "mat " * 30), (2**62, "cat " * 20), (-(2**63), "cat " * 21)]
    check(resampling.resample(make_docs(docs, ["rank", "score", "_pos", "n", "a.b"]), target[1], percent=60), docs, target[0], percent=60)


def test_blocks_of_words_meet(make_docs, target, monkeypatch):
    docs = [(1, "a b c d e f g h"), (2, "b"), (3, ""), (4, "c d c d c d c"), (5, "x y")]
    joined = "".join(t for _, t in docs).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for _, t in docs])
    for block in (1, 2, 3, 7, 100):
        monkeypatch.setattr(resampling, "BLOCK_WORDS", block)
        found = [(r, b) for rows, buckets, _ in resampling.feature_blocks(np.frombuffer(joined, np.uint8), offsets, 10_000) for r, b in zip(rows.tolist(), buckets.tolist())]
        assert Counter(found) == Counter((i, b) for i, (_, t) in enumerate(docs) for b in features(t)[1])


def test_empty_tables(make_docs, target, spark):
    assert resampling.resample(make_docs([]), target[1]).count() == 0
    docs = [(1, "the cat " * 15), (2, "a dog"), (3, None)]
    check(resampling.resample(make_docs(docs), target[1].limit(0), percent=100), docs, [], percent=100)
    check(resampling.resample(make_docs([(1, None)]), target[1]), [(1, None)], target[0])


@pytest.mark.parametrize("keys", [("a",), ("a", "b"), ("b", "c", "a")])
def test_radix_order(spark, monkeypatch, keys):
    """Small digits and blocks, so that every pass has many of both; a third of the rows has one key."""
    monkeypatch.setattr(resampling, "DIGIT_BITS", 3)
    monkeypatch.setattr(resampling, "BLOCK_BITS", 4)
    random.seed(5)
    pick = lambda *some: random.choice(some) if random.random() < 0.67 else 7
    rows = [(pick(-3, -(2**63), 2**63 - 1, 0, 12345678901), pick(None, 1, 2, 9), pick(5, 6)) for _ in range(700)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    got = sorted(resampling.radix_positions(df, list(keys)).collect(), key=lambda r: r._pos)
    assert [r._pos for r in got] == list(range(len(rows)))
    order = lambda r: [((x := r["abc".index(k)]) is None, x or 0) for k in keys]
    assert [order((r.a, r.b, r.c)) for r in got] == sorted(map(order, rows))


def test_radix_of_few_rows(spark):
    df = spark.createDataFrame([(4, "x")] * 3, "k long, t string")
    assert sorted(r._pos for r in resampling.radix_positions(df, ["k"]).collect()) == [0, 1, 2]
    assert resampling.radix_positions(df.limit(0), ["k"]).count() == 0
    assert resampling.radix_positions(spark.createDataFrame([(None,), (None,)], "k long"), ["k"]).count() == 2
