"""The shingle join against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import ngram_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    where = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            where[x].add(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in set().union(*(where[x] for x in s)) if s else ():
            both = len(s & sets[j])
            if j < i and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def prose(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 6))) for _ in range(n)]


def change(rng, words, share):
    return [("x" + str(rng.randrange(10**6)) if rng.random() < share else w) for w in words]


def corpus(seed):
    rng = random.Random(seed)
    passage = prose(rng, 40)
    texts = []
    for _ in range(12):  # families with changes from none to many
        base = prose(rng, rng.choice([6, 30, 120, 400]))
        texts += [" ".join(change(rng, base, rng.choice([0, 0.002, 0.01, 0.02, 0.05, 0.3]))) for _ in range(rng.randrange(2, 30))]
    chain = prose(rng, 300)  # each copy is near to its neighbours only
    for i in range(25):
        chain = change(rng, chain, 0.01)
        texts.append(" ".join(chain))
    big = prose(rng, 80)
    texts += [" ".join(change(rng, big, 0.012)) for _ in range(260)]
    texts += [" ".join(prose(rng, rng.randrange(0, 12)) + passage) for _ in range(60)]  # little but a common passage
    texts += [" ".join(prose(rng, rng.randrange(1, 4))) for _ in range(40)] + ["a b c d", "A  B\nc\td", "a b c", "a b c d e"]
    texts += [None, "", " \n\t", "Éa éa b c", "éa éa b c", "w " * 30000, "w " * 200, "x" * 50000]
    texts += [texts[0]] * 150
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(3, "other words here for a used id"), rows[5], rows[5], (None, rows[6][1]), (None, texts[0])]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 95), (1, 100)])
def test_components(make_docs, monkeypatch, k, percent):
    monkeypatch.setattr(J, "GROUP_DOCS", 16)
    monkeypatch.setattr(J, "BUCKET_TOKENS", 500)
    rows = corpus(k)
    docs = make_docs(rows, extra=("id", "n", "sid", "head", "f1", "token", "label"))
    out = J.near_duplicates(docs, words=k, percent=percent).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows, k, percent)


def test_one_of_each(make_docs):
    rows = corpus(4)
    out = J.drop_near_duplicates(make_docs(rows, extra=("first", "body", "row", "id", "own")))
    found = plain(rows, 5, 80)
    firsts = {d for d, _, c in found if d is not None and d == c}
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert len({(d, t) for d, t in got if d is not None}) == len([d for d, _ in got if d is not None])
    assert {d for d, _ in got if d is not None} == firsts and sum(d is None for d, _ in got) == 2


def test_nothing(make_docs):
    assert J.near_duplicates(make_docs([])).count() == 0
    assert [tuple(r) for r in J.near_duplicates(make_docs([(1, None), (2, "a b")])).drop("text_hash").collect()] in ([(1, 0, 1), (2, 1, 2)], [(2, 1, 2), (1, 0, 1)])


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 21])
def test_shingles_of_blocks(monkeypatch, block):
    """Sets are equal however the bytes are cut, and hashes tell all words apart."""
    monkeypatch.setattr(J, "BLOCK_BYTES", block)
    rng = random.Random(1)
    texts = ["", " ", "a", "a b c", "A B c D e", "\U0001f600 é\x0b\x0cz", "", "ab ba aab aba"] + [" ".join(prose(rng, rng.randrange(60))) for _ in range(50)] + [""]
    for column in (pa.array(texts), pa.array(["skip me", *texts, "x"]).slice(1, len(texts))):
        sets, bounds = J.shingle_sets(column, 3)
        assert np.diff(bounds).tolist() == [len(shingles(t, 3)) for t in texts]
        known = {}
        for i, t in enumerate(texts):
            known.setdefault(frozenset(sets[bounds[i] : bounds[i + 1]].tolist()), set()).add(shingles(t, 3))
        assert all(len(v) == 1 for v in known.values())


def test_sizes():
    """The head's guarantee, for all sizes of linked sets: enough tokens in common in both heads."""
    for percent in (80, 85, 95, 100):
        for n in range(1, 400):
            least = 1 + J.overlap(n, percent) * J.HEAD_PERCENT // 100
            for m in range(J.overlap(n, percent), n + 1):
                assert least <= J.extra(m) and J.extra(m) <= J.overlap(n, percent)
            assert J.head(n, percent) >= n - J.overlap(n, percent) + 1


def test_components_of_paths(spark):
    rng = random.Random(2)
    chain = list(range(100, 160))
    edges = list(zip(chain, chain[1:])) + [(7, 900), (900, 8), (5, 5), (1, 2), (2, 1)] + [(3000, i) for i in range(3001, 3200)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in chain[1:]}, 900: 7, 8: 7, 2: 1, **{i: 3000 for i in range(3001, 3200)}}


def test_closed_groups_hold_no_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype("<u8")) for _ in range(80)]
    members = {"set": [s.tobytes() for s in sets[:40]], "label": list(range(40))}
    queries = {"set": [s.tobytes() for s in sets[40:]], "label": list(range(40, 80))}
    both = lambda a, b: len(np.intersect1d(a, b))
    for percent in (40, 60):
        want = {(i + 40, j) for i, a in enumerate(sets[40:]) for j, b in enumerate(sets[:40]) if 100 * both(a, b) >= percent * (len(a) + len(b) - both(a, b))}
        assert set(J.open_groups(queries, members, percent)) == want
