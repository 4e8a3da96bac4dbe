"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pagewright.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(docs, slip=199):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near_to = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in near_to.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near_to[w]), n.get(form[w])) for w in n}


def check(df, docs, **rule):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    want = plain(docs, **rule)
    assert len(got) == len(want) and set(got) == want
    return want


@pytest.mark.parametrize("slip", [199, 3])
def test_rows_of_all_kinds(make_docs, slip):
    random.seed(slip)
    base = ["ananas", "banana", "letter", "étoilé", "straße", "aaaaaaaa", "mississippi", "÷×÷×÷×ÿ", "onthere", "thereon"]
    pool = list(base)
    for w in base:
        for _ in range(6):
            x = random.choice(pool[-6:] + [w])
            at, c = random.randrange(len(x)), random.choice("aeéßzn×")
            pool.append(random.choice([x[:at] + x[at + 1 :], x[:at] + c + x[at:], x[:at] + c + x[at + 1 :]]))
    docs = [(i, " ".join(random.choices(pool + base * 30, k=400)) + ". Ananas, BANANA-Étoilé") for i in range(30)]
    docs += [(100, None), (101, ""), (102, "12 ~ Ω日本語"), (None, "banana " * 700), (7, "letter\n" * 900), (7, "letter\n" * 900), (103, "x" * 50_000 + " "), (104, ("lettre " + "y" * 20_000 + " ") * 6)]
    want = check(variants.variant_groups(make_docs(docs, ["word", "n", "form", "a.b"]), slip=slip), docs, slip=slip)
    assert sum(w[1] is not None for w in want) > 5


def test_chains_of_forms(make_docs):
    """Counts grow by five at each step: the root is several steps away."""
    words = ["abcdef" + "g" * k for k in range(5)]
    docs = [(k, f"{w} " * (5 * 5**k)) for k, w in enumerate(words)]
    want = check(variants.variant_groups(make_docs(docs), slip=None), docs, slip=2**40)
    assert {w[2] for w in want} == {words[-1]}


def test_ties_go_to_the_first(make_docs):
    docs = [(1, "mother " * 5 + "bother " * 30 + "nother " * 30 + "motherz " * 30)]
    want = check(variants.variant_groups(make_docs(docs), slip=None), docs, slip=2**40)
    assert ("mother", "bother", "bother", 5, 3, 30) in want


def test_empty_tables(make_docs):
    assert variants.variant_groups(make_docs([])).count() == 0
    assert variants.variant_groups(make_docs([(1, None), (2, "short words only")])).count() == 0


def test_signatures_lose_no_pair(spark):
    """Every two letter multisets at most two places apart meet exactly once; few others do."""
    random.seed(8)
    letters = sorted({"".join(sorted(random.choices("aabcdeéÿ", k=random.randrange(5, 9)))) for _ in range(400)})
    classes = spark.createDataFrame([(x, [x]) for x in letters], "letters string, words array<string>")
    got = Counter((r.a, r.b) for r in variants.close_classes(variants.signatures(classes)).collect())
    gap = lambda x, y: (Counter(x) - Counter(y)).total() + (Counter(y) - Counter(x)).total()
    want = {(x, y) for x in letters for y in letters if 0 < gap(x, y) <= 2 and abs(len(x) - len(y)) <= 1 and (len(x), x) < (len(y), y)}
    assert want <= set(got) and max(got.values()) == 1
