"""Line dedup, shards, secrets and quality rules against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagewright.functions.sql import fn as F
from pagewright.llm import credentials, line_dedup, outliers, sharding

WS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n", "\n\n", "a", "Éa ÷ Ünd ß", "x\x0b\x0c y", "\U0001f600 z\n ", "w " * 20000]


# ---- lines -------------------------------------------------------------------------------------


def brute_lines(rows, min_docs, min_chars=1):
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            held[line.strip(WS).translate(LOWER)].add((d, t))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(k := x.strip(WS).translate(LOWER)) >= min_chars and len(held[k]) >= min_docs)]
        out.append((d, None if t is None else "\n".join(kept)))
    return out


def test_lines(make_docs):
    rng = random.Random(1)
    pool = ["Shared line", " shared LINE\t", "Éa", "éa", "", "  ", "b", "B ", "rare", "\x0b", "Straße", "STRASSE", "ÀB", "Àb"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", "", str(i)]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "Shared line\nx"), (3, "other\nshared line"), rows[5], rows[5]]
    docs = make_docs(rows, extra=("doc", "pos", "line", "key", "h1", "p", "body", "dropped", "row", "id", "own"))
    for k in (2, 5, 10):
        out = line_dedup.drop_frequent_lines(docs, min_docs=k)
        assert out.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(brute_lines(rows, k), key=repr)


def test_line_bitmaps(make_docs):
    rows = [(i, "a\nb\nA\n\nc%d\nb" % i) for i in range(3)] + [(9, "d")]
    got = {r.doc: [tuple(x) for x in r.dropped] for r in line_dedup.line_drop_bitmaps(make_docs(rows), min_docs=3).collect()}
    assert got == {i: [(0, 2), (5, 5)] for i in range(3)}
    assert line_dedup.line_drop_bitmaps(make_docs([])).count() == 0 and line_dedup.drop_frequent_lines(make_docs([])).count() == 0


def test_first_lines_need_one_exchange(make_docs):
    plan = line_dedup.first_lines(line_dedup.line_rows(make_docs([(1, "a\na")])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


# ---- shards ------------------------------------------------------------------------------------


def test_hilbert_neighbours(spark):
    """Along the curve, every cell comes once and differs from the one before by one step along one axis."""
    for axes, bits in ((2, 3), (3, 3)):
        names = [f"a{i}" for i in range(axes)]
        cells = spark.range(1 << (axes * bits)).selectExpr(*[f"CAST(shiftright(id, {i * bits}) & {(1 << bits) - 1} AS int) AS {n}" for i, n in enumerate(names)])
        rows = sorted(sharding.hilbert_index(cells, names, bits, "h").collect(), key=lambda r: r.h)
        assert [r.h for r in rows] == list(range(len(rows)))
        assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("n", [0, 1, 5, 240])
def test_shards(make_docs, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(ODD[:-1] + ["t" * rng.randrange(900)]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "", None])) for i in range(n)]
    rows += rows[:7] + [(None, "x", "en", "s1")] * min(n, 3)
    out = sharding.hilbert_shards(make_docs(rows, extra=("size", "bin", "curve", "rank")), 8).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    sizes = [len(shards[i]) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1 and set(shards) <= set(range(8))
    last = None
    for i in range(8):
        assert sorted(r.slot for r in shards[i]) == list(range(len(shards[i])))
        for r in sorted(shards[i], key=lambda r: r.slot):  # runs of the curve
            assert last is None or r.curve >= last
            last = r.curve


# ---- secrets -----------------------------------------------------------------------------------


def brute_base(t):
    kinds = [
        ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[1]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), n, m.end(), k) for n, (k, p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


HEX, KEY = "0123456789abcdef01234567", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
SAMPLES = [
    "password=hunter22 x", "é password: 'abc' secret=token:abcdefgh", "TOKEN = \"" + HEX + "\"", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 12,
    HEX[:-1] + " " + HEX, "\U0001f600api_key=" + HEX + "\napikey:" + HEX, "secretsecret==abcdefg", "token=\x20\x20abc-def", "password='" + "a" * 30000 + "' " + HEX,
]


def test_base_secrets(make_docs):
    rng = random.Random(4)
    bits = ["password", "=", ":", " ", "'", "token", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", HEX, "é", "\n", "api_key", "x", "12345"]
    rows = [(i, t) for i, t in enumerate(SAMPLES + ODD)] + [(1000 + i, "".join(rng.choices(bits, k=rng.randrange(1, 25)))) for i in range(400)]
    out = credentials.scan_secrets(make_docs(rows, extra=("_m", "_ms", "_gaps", "_s_hex", "_parts", "row", "start", "kind"))).select("doc_id", "text", credentials.span_text("_base").alias("b").col).collect()
    assert len(out) == len(rows)
    assert [(r.doc_id, r.b) for r in out if r.b != brute_base(r.text)] == []


def linked(make_docs, *texts):
    df = credentials.scan_secrets(make_docs(list(enumerate(texts))))
    return [[(s.kind, r.text[s.start:s.end]) for s in r["_linked"]] for r in df.orderBy("doc_id").collect()]


def test_linked_parts(make_docs):
    far = " word" * 60
    got = linked(
        make_docs, f"user=alice {KEY}", f"only {KEY}", "user=alice at https://example.org/a", f"user=alice{far} {KEY}", f"user=alice\n \n{KEY}",
        f"AKIA{'Q' * 16} and {KEY}", "host=db1.example and password=hunter22", "plain words and nothing else", f"user=alice {'a' * 40}",
    )
    assert got[0] == [("ident", "user=alice"), ("key", KEY)]
    assert got[1] == [] and got[2] == [] and got[3] == [] and got[4] == [] and got[7] == [] and got[8] == []
    assert got[5] == [("key", KEY)]
    assert got[6] == [("endpoint", "host=db1.example")]


def test_redaction(make_docs):
    docs = make_docs([(1, f"a password={HEX} b"), (2, None), (3, "clean"), (4, f"user=bob {KEY}\n")], extra=("row",))
    out = {r.doc_id: r.text for r in credentials.redact_secrets(docs).collect()}
    assert out == {1: "a [SECRET] b", 2: None, 3: "clean", 4: "[SECRET] [SECRET]\n"}


def test_texts_full_of_secrets(make_docs):
    """Places and marks over many blocks, with characters of one to four bytes; time follows the text's length."""
    rng = random.Random(9)
    bits = ["token=abcdef12 user=bob99 ", f"é\U0001f600 {HEX}", "\n\n", "password: 'hunter22'\n", "日 " * 700, "x", f"{HEX}{HEX} "]
    texts = ["".join(rng.choices(bits, k=k)) for k in (600, 1500, 5000)] + ["token=abcdef12 user=bob99 " * 40_000, HEX + "g", "token=abcdef"]
    out = credentials.redact_secrets(make_docs(list(enumerate(texts)))).collect()
    found = credentials.scan_secrets(make_docs(list(enumerate(texts)))).select("doc_id", "_linked", credentials.span_text("_base").alias("b").col).collect()
    redacted = {r.doc_id: r.text for r in out}
    for r in found:
        text = texts[r.doc_id]
        assert r.b == brute_base(text)
        spans = [x.split(":") for x in r.b.split(",")] + [(s.kind, s.start, s.end) for s in r["_linked"]]
        pieces, at = [], 0
        for start, end in sorted((int(s), int(e)) for _, s, e in spans):
            if start >= at:
                pieces.append(text[at:start])
            at = max(at, end)
        assert redacted[r.doc_id] == "[SECRET]".join([*pieces, text[at:]])
    assert sum(len(r["_linked"]) for r in found) > 40_000


# ---- quality -----------------------------------------------------------------------------------


def brute_stats(t, word_list):
    t = t or ""
    w = word_list(t)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.strip(WS)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t), len(lines) - len(set(lines)), len(covered)


def test_statistics(make_docs, word_list):
    rng = random.Random(2)
    rows = list(enumerate(ODD + ["a b c d e f g h\na b c d e f g h", "a " * 8, "a " * 9, "a b\na b\n a b\n\n", "#|<>x y"]))
    rows += [(100 + i, " ".join(rng.choices("abc", k=rng.randrange(60)))) for i in range(100)] + [(300 + i, "\n".join(rng.choices(["p q r s t u v w x", "k", "A#", "l m n"], k=12))) for i in range(40)]
    out = outliers.text_statistics(make_docs(rows)).collect()
    bad = [r.doc_id for r in out if tuple(r[c] for c in outliers.STATISTICS) != brute_stats(r.text, word_list)]
    assert len(out) == len(rows) and bad == []


def test_chi_square():
    assert math.isclose(outliers.chi2_cdf(6.251388631170325, 3), 0.9, rel_tol=1e-9)
    assert math.isclose(outliers.chi2_quantile(0.975, 5), 12.832501994, rel_tol=1e-8)


def test_estimates_equal_numpy(spark):
    """Concentration steps on one group against the same steps in numpy."""
    rng = np.random.default_rng(3)
    x = np.round(np.vstack([rng.normal(0, 1, (400, 3)) @ [[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]], rng.normal(8, 1, (60, 3))]) * outliers.UNIT).astype(int)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "_group string, a long, b long, c long")
    floors = {"a": 0.1, "b": 0.1, "c": 0.1}
    got = outliers.fit(rows, floors).first()
    ridge, factor = np.eye(3) * (0.1 * outliers.UNIT) ** 2, outliers.consistency(0.75, 3)
    best = None
    for start in range(2):
        m, c = x.mean(0), np.cov(x.T, bias=True)
        c = (c if start == 0 else np.diag(np.diag(c))) + ridge
        before = None
        for _ in range(outliers.STEPS):
            d = ((x - m) @ np.linalg.inv(c) * (x - m)).sum(1)
            b = np.floor(np.log2(1e-6 + d) * 64)
            inside = b <= np.sort(b)[math.ceil(0.75 * len(x)) - 1]
            near = x[inside]
            m, c = near.mean(0), np.cov(near.T, bias=True) * factor + ridge
            done, before = before is not None and (inside == before).all(), inside
            if done:
                break
        assert done
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    assert np.allclose(got["_m"], best[1]) and np.all(np.abs(np.array(got["_m"]) / outliers.UNIT) < 1)
    w = np.zeros((3, 3))
    w[np.tril_indices(3)] = got["_w"]
    assert np.allclose(w.T @ w, np.linalg.inv(best[2]))


def prose(rng, n):
    return " ".join("".join(rng.choices("aeioulnrst", k=rng.randrange(2, 9))) for _ in range(n))


def test_verdicts(make_docs):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(25, 400)), "en", "s%d" % (i % 2)) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "s0") for i in range(12)]
    rows += [(2000 + i, prose(rng, 60), None, None) for i in range(3)]
    rows += [(3000, None, "en", "s0"), (3001, "", "en", "s0"), (3002, "same words here again and more " * 30, "en", "s1"), rows[0], (None, rows[1][1], "en", "s1")]
    docs = make_docs(rows, extra=("_n", "_group", "kept", "n_words"))
    out = outliers.quality_verdicts(docs, ["doc_id"]).collect()
    kept = Counter(r.doc_id for r in out if r.kept)
    want = Counter([i for i in range(200)] + [2000, 2001, 2002, 0, None])
    assert kept == want and len(out) == len(rows)
    assert {r.doc_id for r in out if r.base_failed} == {3000, 3001, 3002}
    left = outliers.drop_outliers(docs)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == want
    assert outliers.quality_verdicts(make_docs([]), ["doc_id"]).count() == 0
    assert outliers.drop_outliers(make_docs([(1, "a")])).count() == 0


def test_small_pools(make_docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, 50), ("a", "b", None)[i % 3], f"s{i % 40}") for i in range(90)]
    for least in (25, 1000):
        out = outliers.quality_verdicts(make_docs(rows), ["doc_id"], min_group=least).collect()
        assert all(r.kept and r.distance is not None for r in out) and len(out) == 90


def junk(rng):
    return " ".join(w + "###" for w in prose(rng, 80).split())


@pytest.mark.parametrize("good", [("en", "web"), ("fr", "web")])
def test_rare_source_is_judged(make_docs, good):
    """49 junk rows of one source beside many good ones of its language, or of another."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(25, 300)), *good) for i in range(1000)] + [(5000 + i, junk(rng), "en", "rare") for i in range(49)]
    kept = {r.doc_id for r in outliers.quality_verdicts(make_docs(rows), ["doc_id"]).collect() if r.kept}
    assert kept == set(range(1000))


def test_table_of_few_rows_is_judged(make_docs):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(25, 300)), "en", f"s{i}") for i in range(43)] + [(100 + i, junk(rng), "en", "s") for i in range(6)]
    out = outliers.quality_verdicts(make_docs(rows), ["doc_id"]).collect()
    assert {r.doc_id for r in out if r.kept} == set(range(43)) and all(r.distance is not None for r in out)
    assert [r.kept for r in outliers.quality_verdicts(make_docs([(1, prose(rng, 50))]), ["doc_id"]).collect()] == [True]


def test_pooled_groups(spark):
    counts = {("a", "x"): 60, ("a", "y"): 10, ("b", "x"): 20, ("b", "y"): 40, ("c", "x"): 3, (None, "z"): 1}
    rows = spark.createDataFrame([k for k, n in counts.items() for _ in range(n)], "l string, s string").selectExpr("*", "1L AS f")
    groups = outliers.pooled_groups(rows, ("l", "s"), 50)
    assert {(r.l, r.s): r._cut for r in groups.collect()} == {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 1, ("c", "x"): 0, (None, "z"): 0}
    members = Counter(r._group for r in outliers.group_members(rows, groups, ("l", "s"), ["f"]).collect())
    assert sorted(members.values()) == [60, 60, 70, 134]
