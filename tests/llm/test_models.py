"""Packing, byte-level BPE, top-k products and chat repair against plain Python."""

import base64
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagewright.llm import bpe, chat, packing, topk

# ---- packing -----------------------------------------------------------------------------------


def plain_best_fit(lengths, capacities, cost):
    """Every open bin is looked at for every piece."""
    bins, out = [], []

    def price(c, i):
        fill = 0
        for n in lengths[i:]:
            fill += n if fill + n <= c else 0
        return cost(min(x for x in capacities if x >= fill)) / fill, c

    for k, n in enumerate(lengths):
        fits = [(cap - used, i) for i, (cap, used) in enumerate(bins) if cap - used >= n and cap > used]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append([min((c for c in capacities if c >= n), key=lambda c: price(c, k)), 0])
        out.append((i, bins[i][1]))
        bins[i][1] += n
    return out, [min(c for c in capacities if c >= used) for _, used in bins]


def test_repeated_rows_are_spread(make_docs):
    """Equal rows under a NULL id fill several shards."""
    out = packing.pack_documents(make_docs([(None, "a b c")] * 2000), capacities=(16, 64), shard_pieces=100).select("bin_id").collect()
    shards = Counter(r.bin_id >> 32 for r in out)
    assert len(out) == 2000 and len(shards) == 20 and max(shards.values()) < 200


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    rng = random.Random(seed)
    sizes = (8, 16, 40)
    lengths = sorted((rng.randrange(1, 41) for _ in range(rng.randrange(1, 200))), reverse=True)
    bins, offsets, caps = packing.best_fit(lengths, sizes, packing.sequence_cost)
    assert (list(zip(bins, offsets)), caps) == plain_best_fit(lengths, sizes, packing.sequence_cost)


def test_jointly_chosen_sizes():
    """A long size pays only if its bins fill; all sizes together cost no more than any one."""
    assert packing.best_fit([100], (512, 1024, 2048))[2] == [512]
    sizes = (512, 1024, 2048, 4096)
    for lengths in ([400] * 50, [500, 300, 300, 200, 100, 50, 50, 20], list(range(500, 0, -3))):
        total = lambda caps: sum(map(packing.sequence_cost, packing.best_fit(lengths, caps)[2]))
        assert total(sizes) <= min(total((c,)) for c in sizes)


def test_pack_documents(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([1, 3, 50, 300])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n \t"), (203, "x " * 1000), (None, "a b c"), (None, "d e"), rows[0], rows[0]]
    docs = make_docs(rows, extra=("piece", "length", "n", "bin_id", "_shard"))
    out = packing.pack_documents(docs, capacities=(16, 64, 128), shard_pieces=50).collect()
    want = Counter()
    for d, t in rows:
        n = len((t or "").split())
        for at in range(0, max(n, 1), 128):
            want[d, at // 128, at, min(128, n - at)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        assert (r.length == 0) == (r.bin_id is None)
        if r.length:
            bins[r.bin_id].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
        used = sum(r.length for r in held)
        assert {r.capacity for r in held} == {min(c for c in (16, 64, 128) if c >= used)}
    again = packing.pack_documents(docs.repartition(5), capacities=(16, 64, 128), shard_pieces=50).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    assert packing.pack_documents(make_docs([])).count() == 0


# ---- byte-level BPE ----------------------------------------------------------------------------


def whole_text_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(make_docs):
    rng = random.Random(7)
    bits = [" ", "  ", "\n", "\t", "\x85", " ", "\x1c", "a", "word", "it's", "'ll", "é", "日本", "12", "!?", "\U0001f600", "<|endoftext|>", " ", "é"]
    texts = [None, "", " ", "\n\n", "x" * 5000] + ["".join(rng.choices(bits, k=rng.randrange(1, 120))) for _ in range(300)] + [" ".join(rng.choices(bits, k=30000))]
    enc = whole_text_encoding()
    docs = make_docs(list(enumerate(texts)), extra=("ids_", "decoded_"))
    for size in (3, 20, 1 << 16):
        out = bpe.decode_ids(bpe.encode_text(docs, piece_chars=size)).collect()
        assert len(out) == len(texts)
        for r in out:
            assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_text(make_docs([])).count() == 0


def by_matches(enc, text):
    """Ids of each match by itself; the matches come from another regular-expression library."""
    import public_tokenizers as P
    import regex

    return [i for m in regex.finditer(P.PATTERN, text) for i in enc._encode_single_piece(m[0])]


WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def test_bpe_of_long_runs(make_docs):
    """Runs at the ends and in the middle, far over what the library's regular expression takes."""
    n = 5_000_000
    texts = [" " * n + "a" + "\n" * n + "word", "x" + "\t" * n, "\u3000" * n, "a" * n, "7" * n + " !", "e" + "\u0301" * n, "日" * n]
    texts += [f"be{c * 1_000_000}{d}en{c * 5000}" for c, d in zip(WHITE, WHITE[1:] + " ")] + [" " * 4095 + "a" + " " * 4096 + "b" + "\n" * 4097 + "!", "a\x1c" + " \n" * 3000 + "\x1c"]
    enc = whole_text_encoding()
    out = bpe.decode_ids(bpe.encode_text(make_docs(list(enumerate(texts))).repartition(8))).select("doc_id", "ids", "decoded").collect()
    for r in out:
        assert bytes(r.decoded) == texts[r.doc_id].encode()
        assert r.ids == np.array(by_matches(enc, texts[r.doc_id]), "<u4").tobytes()
    assert len(out) == len(texts)


def test_bpe_equals_another_library(make_docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["The quick brown fox, it's 42!", "Über naïve  façade\n\n end", "<|endoftext|> plain", "a" * 300]
    for r in bpe.encode_text(make_docs(list(enumerate(texts)))).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode(r.text, add_special_tokens=False).ids


def test_raw_bytes(spark):
    """Ids whose bytes end inside a character."""
    enc = whole_text_encoding()
    ids = enc.encode_ordinary("\U0001f9ff")
    assert len(ids) > 1
    df = spark.createDataFrame([(bytearray(np.array(ids[:1], "<u4").tobytes()),), (None,)], "ids binary")
    assert [bytes(r.decoded) for r in bpe.decode_ids(df).collect()] == [enc.decode_bytes(ids[:1]), b""]


# ---- top-k products ----------------------------------------------------------------------------


def plain_top(rows, k):
    whole = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((n, i, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for n, i, q in whole:
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in whole if m != n and len(v) == len(q))
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return Counter(out)


@pytest.mark.parametrize("kind", ["normal", "spread", "copies", "few"])
def test_top_products(spark, kind):
    rng = np.random.default_rng(3)
    n, dim = (3, 4) if kind == "few" else (700, 6)
    x = rng.normal(0, 0.2, (n, dim))
    if kind == "spread":
        x *= rng.lognormal(0, 1.5, (n, 1))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    if kind == "copies":
        rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
        rows += [(50, rows[50][1]), (100, rows[3][1]), (None, rows[0][1]), (150, None), (200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (250, [float("nan")] * 6), (300, [float("inf")] * 6)]
        rows += [(350, [1.0, 2.0]), (351, [3.0, -1.0]), (400, []), (401, []), (450, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS score", "3 AS dim", "4 AS block")
    out = topk.top_inner_products(df, "vec_id", "embedding", "id % 50 = 0", bucket_rows=64, query_rows=5)
    assert Counter(map(tuple, out.collect())) == plain_top(rows, 5)


def test_top_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_inner_products(df, "vec_id", "embedding", "id % 50 = 0").count() == 0


def test_large_components():
    a = np.array([[1 << 40, 3]], dtype=np.int64)
    assert topk.products(a, np.array([[5, 7]], dtype=np.int64)).tolist() == [[5 * (1 << 40) + 21]]
    assert topk.products(a, a).tolist() == [[(1 << 63) - 1]]


# ---- chat --------------------------------------------------------------------------------------


def plain_cost(roles):
    """Least cost over all ways, by trying every action in every state."""
    legal = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    def relabel(r, new):
        return 0 if r == new else 3 if r in ("system", "user", "assistant") else 1

    costs = {None: 0}
    for r in roles:
        new = {}
        for before, c in costs.items():
            for inserted in ((), *itertools.product(("user", "assistant"), repeat=1)):
                state, ok = before, True
                for x in inserted:
                    ok &= x in legal[state]
                    state = x
                for to in legal[state] if ok else ():
                    new[to] = min(new.get(to, 1 << 30), c + 2 * len(inserted) + relabel(r, to))
            if before:
                new[before] = min(new.get(before, 1 << 30), c + 1 + relabel(r, before))
        costs = new
    return min(c + {None: 0, "system": 4, "user": 2, "assistant": 0}[s] for s, c in costs.items())


def messages(rendered):
    """(role, text) of a rendered conversation; fails if it isn't well formed."""
    out = []
    while rendered:
        assert rendered.startswith("<|im_start|>")
        body, rendered = rendered[len("<|im_start|>"):].split("<|im_end|>\n", 1)
        out.append(tuple(body.split("\n", 1)))
    return out


def test_repair(spark):
    rng = random.Random(9)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice([None, "", f"text {c} {t}"])))
    rows += [(500, t, rng.choice(["user", "assistant"]), f"t{t}") for t in range(400)] + [(501, t, "system", "s") for t in range(40)]
    rows += [(None, None, "user", "x"), (None, 1, "user", "x"), (None, 1, "user", "x"), (None, 1, "assistant", "y"), (502, 0, "user", "twice"), (502, 0, "user", "twice")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS row", "2 AS seg", "3 AS pos", "4 AS conv")
    outcome = None
    for segment in (4, 64, 16384):
        out = chat.repair_turns(df, segment=segment).collect()
        assert Counter((r.conv_id, r.turn, r.role) for r in out) == Counter(r[:3] for r in rows)
        assert outcome is None or Counter(map(tuple, out)) == outcome
        outcome = Counter(map(tuple, out))
    null_first = lambda x: (x is not None, x or 0)
    text = defaultdict(list)
    for r in rows:
        text[r[0]].append(r)
    by = defaultdict(list)
    for r in out:
        by[r.conv_id].append(r)
    for conv, rs in by.items():
        turns = sorted(text[conv], key=lambda r: (null_first(r[1]), r[2] is not None, r[2] or "", __import__("hashlib").md5((r[3] or "").encode()).hexdigest()))
        assert sum(r.cost for r in rs) == plain_cost([r[2] for r in turns])
        if len({r[1] for r in turns}) == len(turns):
            got = messages("".join(r.rendered for r in sorted(rs, key=lambda r: null_first(r.turn))))
            roles = [m[0] for m in got]
            body = roles[1:] if roles[0] == "system" else roles
            assert body == ["user", "assistant"] * (len(body) // 2) and body
            assert "\n".join(t for _, t in got).split() == " ".join(r[3] or "" for r in turns).split()


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    out = chat.repair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [(r.action, r.new_role, r.cost) for r in out] == [("place", x, 0) for x in ("system", "user", "assistant")]
    assert "".join(r.rendered for r in out) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert chat.repair_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
