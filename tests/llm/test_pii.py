"""Personal data: fixed patterns against plain regular expressions, the field against brute force and held-out rows."""

import itertools
import random
import re

import numpy as np

from pagewright.llm import pii


def plain_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


SAMPLES = [
    None, "", "a@b", "a@b.c", "a@b..c d", "x@y.z@w.v", "a.b+c@d-e.f.g.", "@a.b", "é@a.bé", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "01.002.3.255",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12345678", "+1 2 3 4 5 6 7 8 9 (", "+1234567890123456", "\U0001f600 +44 20 7946 0958, x",
    "4111 1111 1111 1111 4111 1111 1111 1111", "1" * 40000, "a" * 40000 + "@", "1." * 20000,
]


def test_base_spans(make_docs):
    rng = random.Random(3)
    bits = ["a", "@", ".", "-", "+", "1", "23", "4111111111111111", " ", "(", ")", "555", "\n", "é", "192.168.0.1", "%"]
    texts = SAMPLES[:-3] + ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(3000)]
    assert [t for t in texts if pii.base_spans(t or "") != plain_spans(t)] == []
    model = pii.train_crf([], [])
    docs = make_docs(list(enumerate(SAMPLES)), extra=("start", "kind", "found", "row"))
    out = pii.find_personal_data(docs, model).collect()
    assert len(out) == len(SAMPLES)
    assert [r.doc_id for r in out if len(r.text or "") < 9999 and [tuple(s) for s in r["_base"]] != plain_spans(r.text)] == []
    assert not any(r["_field"] for r in out)
    assert pii.find_personal_data(make_docs([]), model).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    runs = [[[f"x{rng.integers(4)}", f"y{rng.integers(3)}"] for _ in range(n)] for n in (1, 2, 3, 4, 3)]
    tags = [[int(rng.integers(0, 2)) for _ in run] for run in runs]
    model = pii.train_crf(runs, tags, epochs=5)
    model["emit"] = model["emit"] + rng.normal(size=model["emit"].shape) * (np.arange(len(model["emit"])) < len(model["index"]))[:, None]
    k = len(pii.TAGS)

    def score(run, path):
        total = model["begin"][path[0]]
        for t, (feats, tag) in enumerate(zip(run, path)):
            total += sum(model["emit"][model["index"][f], tag] for f in feats) + (model["move"][path[t - 1], tag] if t else 0)
        return total

    for run, (path, lead) in zip(runs, pii.viterbi(model, runs)):
        best = max(itertools.product(range(k), repeat=len(run)), key=lambda p: score(run, p))
        assert np.isclose(score(run, path), score(run, best)) and np.isclose(lead, score(run, best) - score(run, [0] * len(run)))


def test_gradient_reaches_the_labels():
    runs = [[["a"], ["b"]], [["b"], ["a"]], [["a"]], [["b"]]]
    tags = [[1, 2], [0, 1], [1], [0]]
    model = pii.train_crf(runs, tags, epochs=300)
    assert [p for p, _ in pii.viterbi(model, runs)] == tags


def sentence(rng):
    word = lambda: "".join(rng.choices("aeiourstln", k=rng.randrange(2, 8)))
    kind = rng.randrange(7)
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    made = [
        f"{word()}{rng.choice(['.' + word(), '.' + d(2), d(1), ''])}@{word()}{rng.choice(['.com', '.' + word() + '.org'])}", f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", None,
        f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"version {rng.randrange(9)}.{rng.randrange(9)}", f"in {d(4)}", f"{d(2)} %",
    ][kind]
    if kind == 2:
        made = next(x for x in (d(4) + d(4) + d(4) + d(4) for _ in itertools.count()) if pii.luhn(x))
    return " ".join([*(word() for _ in range(4)), made, *(word() for _ in range(3))])


def test_held_out_accuracy():
    rng = random.Random(1)
    data = [sentence(rng) for _ in range(900)]
    runs = [(run, pii.tags_of(run, pii.base_spans(t))) for t in data for run in pii.open_runs(t)]
    train, held = runs[:600], runs[600:]
    model = pii.train_crf([[i[3] for i in r] for r, _ in train], [t for _, t in train])
    found = pii.viterbi(model, [[i[3] for i in r] for r, _ in held])
    right = sum(path == tags for (path, _), (_, tags) in zip(found, held))
    assert right / len(held) > 0.97


def test_field_adds_spans_to_text(make_docs):
    """The trained field finds a telephone number that the fixed patterns miss, and leaves other text alone."""
    rng = random.Random(2)
    docs = make_docs([(i, sentence(rng)) for i in range(500)])
    labelled = pii.labelled_runs(docs)
    model = pii.train_crf([f for f, _ in labelled], [t for _, t in labelled])
    again = pii.labelled_runs(docs.repartition(7))
    assert again == labelled
    probes = [(0, "call +1 (555) 010-9999x now"), (1, "see version 4.2 in 1999 or 12 %"), (2, "plain words"), (3, "write to a.b@c now")]
    out = {r.doc_id: r for r in pii.find_personal_data(make_docs(probes), model, margin=0.5).collect()}
    assert [s.kind for s in out[0]["_base"]] == ["phone"]
    assert not out[1]["_field"] and not out[2]["_field"]
    assert [(s.kind, out[3].text[s.start:s.end]) for s in out[3]["_field"]] == [("email", "a.b@c")]


def test_addresses_with_endless_parts(make_docs):
    """A dotted form with a part of thousands of digits is no address, or one with leading zeros; the query goes on."""
    texts = ["1.2.3." + "9" * 5000, "1.2.3." + "0" * 5000 + "4", "9" * 5000 + ".1.2.3 and 1.2.3.4", "1.2.3." + "0" * 5000]
    want = [[], [(0, 1, 5007, "ip")], [(5011, 1, 5018, "ip")], [(0, 1, 5006, "ip")]]
    assert [[s for s in pii.base_spans(t) if s[3] == "ip"] for t in texts] == want
    docs = make_docs(list(enumerate(texts)))
    pii.labelled_runs(docs)
    out = {r.doc_id: r for r in pii.find_personal_data(docs, pii.train_crf([], [])).collect()}
    assert [[tuple(s) for s in out[i]["_base"] if s.kind == "ip"] for i in range(4)] == want


def test_field_finds_forms_beyond_the_patterns_at_the_query_margin(make_docs):
    """Trained over a table full of forms that the patterns miss, the field still adds them, with no margin but the query's."""
    probes = ["call (555) 123-4567 now", "write to (jane.doe@localhost), please", "ask at 0171/2345678 today", "version 4.2.1 in 1999, 12 % of 1,200.50", "of 2026-12-01 at 10:15, ISBN 978-3-16-148410-0"]
    docs = make_docs([(i, f"{t} +1 (555) 010-{9000 + i}") for i, t in enumerate(probes * 40)])
    labelled = pii.labelled_runs(docs)
    model = pii.train_crf([f for f, _ in labelled], [t for _, t in labelled])
    out = {r.doc_id: r for r in pii.find_personal_data(make_docs(list(enumerate(probes))), model).collect()}
    assert [[(s.kind, probes[i][s.start:s.end]) for s in out[i]["_field"]] for i in range(5)] == [[("phone", "(555) 123-4567")], [("email", "jane.doe@localhost")], [("phone", "0171/2345678")], [], []]

    rng = random.Random(99)
    right = wrong = wanted = 0
    for text, spans in (pii.made_row(rng) for _ in range(2000)):
        base = pii.base_spans(text)
        beyond = lambda found: {s for s in found if not any(b[0] < s[2] and b[2] > s[0] for b in base)}  # noqa: E731, B023
        runs = pii.open_runs(text)
        tagged = zip(runs, pii.viterbi(model, [[i[3] for i in r] for r in runs]))
        added = beyond([s for run, (tags, lead) in tagged if lead >= pii.MARGIN for s in pii.field_spans(run, tags)])
        want = beyond(spans)
        right, wrong, wanted = right + len(added & want), wrong + len(added - want), wanted + len(want)
    assert wanted > 500 and right / wanted > 0.7 and wrong / right < 0.01


def test_outer_brackets_are_no_part_of_spans():
    for text, want in [("((555) 123-4567).", "(555) 123-4567"), ("(a@b)", "a@b"), ("a@b)###", "a@b"), ("(" * 50000 + "1", "1"), ("(1) (2)", "(1) (2)")]:
        run = [item for run in pii.open_runs(text) for item in run]
        start, end = pii.trimmed(run)
        assert text[start:end] == want


def test_shapes_read_whole_tokens():
    """The end of a long token reaches its shape and features; shapes stay short; short ones are as they were."""
    long = "https://h.example/" + "ab/" * 30
    a, b = (pii.token_features(long + end, "", "") for end in ("jane@host9", "index"))
    for prefix in ("s=", "b=", "c=", "l="):
        pick = lambda feats: [f for f in feats if f.startswith(prefix)]  # noqa: E731, B023
        assert pick(a) != pick(b)
    assert pii.shape("1" * 100 + "X") == "9A" and pii.shape("(555)") == "(9)"
    middle = [pii.shape("a1" * 100 + mark + "a1" * 100) for mark in ("@", "-")]
    assert middle[0] != middle[1] and all(len(s) < 100 for s in middle)


def test_training_runs_are_bounded(make_docs):
    """One document with thousands of addresses gives no more runs than asked for, and the same ones each time."""
    docs = make_docs([(1, "\n".join(f"mail user{i}@host{i}.example.org now" for i in range(1500))), (2, "write a@b.example.com please")])
    made = len(pii.made_runs())
    runs = pii.labelled_runs(docs, max_runs=50)
    assert len(runs) - made == 50 and runs == pii.labelled_runs(docs.repartition(3), max_runs=50)
    assert len(pii.labelled_runs(docs)) - made == 1501
