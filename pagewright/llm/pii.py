"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import DataFrame, functions as S

KINDS = ("email", "ip", "card", "phone")
EMAIL_HOST = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Begun at the first digit of a run, as the leftmost match is, and without giving digits back: linear in any text.
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL = r"[A-Za-z0-9._%+-]"
TOKEN = r"[^\x20\x09-\x0D]+"
#: Only tokens that match this may carry a tag; all others are outside by the model's definition, so the chain
#: falls apart into runs of such tokens and the rest of a text needs no decoding.
OPEN_TOKEN = r"[0-9@]"
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SAMPLE_ROWS = 400  # documents with base spans that the query's model is trained on
MADE_ROWS = 4_000  # rows from templates that it is trained on
LONGEST_RUN = 64  # tokens of a run that is trained on
#: Runs of stored texts in the training sample at most.
MAX_RUNS = 4000
#: Texts that may hold a span of a fixed pattern.
LIKELY = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[\x20-]?[0-9]){11}"
EPOCHS, RATE, DECAY = 150, 0.5, 1e-4
EDGE = ".,;:!?\"'<>[]{}#$%&*"  # punctuation that no span begins or ends with
MARGIN = 4.0  # log odds against "all outside" that a run's best path must reach

Span = tuple[int, int, int, str]


# ---- patterns ----------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end, kind) of the fixed patterns: leftmost, non-overlapping per kind, code points.

    Addresses are looked for around each @ only, so a long run without one costs nothing more.
    """
    out: list[Span] = []
    at, done = text.find("@"), 0
    host, local = re.compile(EMAIL_HOST), re.compile(LOCAL)
    while at >= 0:
        start = at
        while start > done and local.match(text[start - 1]):
            start -= 1
        m = host.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, 0, done, "email"))
        at = text.find("@", at + 1)
    if re.search("[0-9]", text):
        for m in re.finditer(IP, text):
            # By length first: int() refuses texts of over 4,300 digits.
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                out.append((m.start(), 1, m.end(), "ip"))
        for m in re.finditer(CARD, text):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end(), "card"))
        for m in re.finditer(PHONE, text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


# ---- tokens, shapes, labels --------------------------------------------------------------------


def shape(token: str) -> str:
    """Capitals to A, small letters to a, digits to 9, white space and marks as they are; runs of one sign shortened.

    The whole token is read. A shape that stays longer than 64 signs is named by its ends and a hash of all of it.
    """
    s = re.sub(r"(.)\1+", r"\1", "".join("9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in token))
    return s if len(s) <= 64 else f"{s[:24]}~{hashlib.md5(s.encode('utf-8', 'surrogatepass')).hexdigest()}~{s[-24:]}"


def token_features(token: str, before: str, after: str) -> list[str]:
    """Word-shape features of a token and its neighbours ('' at the ends of a text)."""
    digits, left, right = (sum("0" <= c <= "9" for c in t) for t in (token, before, after))
    stripped = token.strip(".,;:!?\"'()")
    own, bare, p, q = shape(token), shape(stripped), shape(before), shape(after)
    signs = "".join(sorted({shape(c) for c in set(stripped)}))
    groups = ",".join(str(len(g)) for g in re.findall("[0-9]+", token)) if digits <= 20 else ""
    return [
        "bias", f"@={'@' in token}", f"c={signs}", f"s={own}", f"b={bare}", f"d={min(digits, 20)}", f"b={bare},d={min(digits, 20)}", f"f={own[:2]}", f"l={own[-2:]}", f"n={min(len(token), 24)}",
        f"p={p}", f"q={q}", f"p={p},b={bare}", f"b={bare},q={q}",
        f"g={min(left, 20)},{min(digits, 20)},{min(right, 20)}", f"s={own},g={groups}", f"b={bare},g={groups}", f"p={p},b={bare},q={q}",
        f"z={token.lstrip('.,;:!?(')[:1] == '0'},b={bare}",
    ]


def open_runs(text: str) -> list[list[tuple[int, int, str, list[str]]]]:
    """Runs of neighbouring tokens that may carry a tag: (start, end, token, features)."""
    if not re.search(OPEN_TOKEN, text):
        return []
    tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(TOKEN, text)]
    runs, last, is_open = [], -2, re.compile(OPEN_TOKEN)
    for i, (start, end, token) in enumerate(tokens):
        if not is_open.search(token):
            continue
        if last != i - 1:
            runs.append([])
        last = i
        runs[-1].append((start, end, token, token_features(token, tokens[i - 1][2] if i else "", tokens[i + 1][2] if i + 1 < len(tokens) else "")))
    return runs


def tags_of(run: list[tuple], spans: list[Span]) -> list[int]:
    """Tags of a run's tokens from spans: a token that overlaps one begins or goes on with it."""
    tags, last = [], None
    for start, end, *_ in run:
        hit = next((s for s in spans if s[0] < end and s[2] > start), None)
        tags.append(0 if hit is None else 1 + 2 * hit[1] + (hit == last))
        last = hit
    return tags


# ---- the field ---------------------------------------------------------------------------------


def padded(runs, index: dict[str, int]):
    """Feature numbers (runs, longest, features; the last number is empty) and lengths."""
    import numpy as np

    width = max((len(f) for run in runs for f in run), default=1)
    lengths = np.array([len(r) for r in runs])
    ids = np.full((len(runs), max(lengths.max(initial=1), 1), width), len(index), dtype=np.int64)
    for i, run in enumerate(runs):
        for t, feats in enumerate(run):
            for j, f in enumerate(feats):
                ids[i, t, j] = index.get(f, len(index))
    return ids, lengths


def train_crf(runs: list[list[list[str]]], tags: list[list[int]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> dict:
    """Weights that raise the conditional likelihood of labelled runs: forward and backward sums over the chain, adaptive steps.

    ``runs`` holds feature lists per token, ``tags`` tag numbers. Deterministic. Without runs all weights are 0.
    """
    import numpy as np

    index = {f: i for i, f in enumerate(sorted({f for run in runs for feats in run for f in feats}))}
    k = len(TAGS)
    emit, move = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    allowed = np.array([[a[0] != "I" or (b != "O" and b[2:] == a[2:]) for a in TAGS] for b in TAGS])  # I only within its kind
    first = np.array([t[0] != "I" for t in TAGS])
    block, begin = np.where(allowed, 0.0, -1e9), np.where(first, 0.0, -1e9)
    if not runs:
        return {"index": index, "emit": emit, "move": block, "begin": begin}
    ids, lengths = padded(runs, index)
    n, longest, _ = ids.shape
    gold = np.zeros((n, longest), dtype=np.int64)
    for i, t in enumerate(tags):
        gold[i, : len(t)] = t
    live = np.arange(longest)[None, :] < lengths[:, None]

    def logsum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    seen_e, seen_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    pairs = np.zeros((k, k))
    for t in range(1, longest):
        np.add.at(pairs, (gold[live[:, t], t - 1], gold[live[:, t], t]), 1)
    for _ in range(epochs):
        scores, trans = emit[ids].sum(2), move + block
        alpha = np.empty((n, longest, k))
        alpha[:, 0] = scores[:, 0] + begin
        for t in range(1, longest):
            alpha[:, t] = scores[:, t] + logsum(alpha[:, t - 1, :, None] + trans[None], 1)
        beta = np.zeros((n, longest, k))
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], logsum(trans[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = logsum(alpha[np.arange(n), lengths - 1], 1)
        share = np.where(live[:, :, None], np.exp(alpha + beta - z[:, None, None]), 0)
        miss = -share
        miss[np.arange(n)[:, None], np.arange(longest)[None, :], gold] += live
        grad_e = np.zeros_like(emit)
        np.add.at(grad_e, ids, miss[:, :, None, :])
        grad_e[-1] = 0
        grad_m = pairs.copy()
        for t in range(1, longest):
            both = alpha[:, t - 1, :, None] + trans[None] + (scores[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            grad_m -= np.where(live[:, t, None, None], np.exp(both), 0).sum(0)
        grad_e, grad_m = grad_e / n - decay * emit, np.where(allowed, grad_m / n - decay * move, 0)
        seen_e += grad_e**2
        seen_m += grad_m**2
        emit += rate * grad_e / np.sqrt(seen_e)
        move += rate * grad_m / np.sqrt(seen_m)
    return {"index": index, "emit": emit, "move": move + block, "begin": begin}


def viterbi(model: dict, runs: list[list[list[str]]]) -> list[tuple[list[int], float]]:
    """Best tags of each run and its score over "all outside"; runs of one length are decoded together."""
    import numpy as np

    out: list = [None] * len(runs)
    by_length: dict[int, list[int]] = {}
    for i, run in enumerate(runs):
        by_length.setdefault(len(run), []).append(i)
    for length, members in by_length.items():
        ids, _ = padded([runs[i] for i in members], model["index"])
        scores, move = model["emit"][ids].sum(2), model["move"]
        best, back = scores[:, 0] + model["begin"], []
        for t in range(1, length):
            ways = best[:, :, None] + move[None]
            back.append(ways.argmax(1))
            best = ways.max(1) + scores[:, t]
        none = scores[:, :, 0].sum(1) + (length - 1) * move[0, 0] + model["begin"][0]
        state = best.argmax(1)
        lead = best.max(1) - none
        path = [state]
        for step in reversed(back):
            state = step[np.arange(len(members)), state]
            path.append(state)
        for row, i in enumerate(members):
            out[i] = [int(p[row]) for p in reversed(path)], float(lead[row])
    return out


def trimmed(tokens: list[tuple]) -> tuple[int, int]:
    """Start and end of neighbouring tokens without outer punctuation and without brackets around the whole or half open."""
    signs = [(start + i, c) for start, _, token, *_ in tokens for i, c in enumerate(token)]
    other, open_at = {}, []  # the bracket that each bracket closes or is closed by
    for i, (_, c) in enumerate(signs):
        if c == "(":
            open_at.append(i)
        elif c == ")" and open_at:
            other[i] = open_at.pop()
            other[other[i]] = i
    first, last = 0, len(signs) - 1
    while first <= last:
        a, z = signs[first][1], signs[last][1]
        if a in EDGE or a == ")" or (a == "(" and other.get(first, last) >= last):
            first += 1
        elif z in EDGE or z == "(" or (z == ")" and other.get(last, -1) < first):
            last -= 1
        else:
            break
    return (signs[first][0], signs[last][0] + 1) if first <= last else (tokens[0][0], tokens[0][0])


def field_spans(run: list[tuple], tags: list[int]) -> list[Span]:
    """Spans of a tagged run, outer punctuation left out. A card number has 12 to 19 digits that pass the Luhn test."""
    groups: list[list] = []
    for item, tag in zip(run, tags):
        if tag and (tag - 1) % 2 and groups:
            groups[-1][1].append(item)
        elif tag:
            groups.append([(tag - 1) // 2, [item]])
    out = []
    for kind, tokens in groups:
        digits = "".join(c for t in tokens for c in t[2] if "0" <= c <= "9")
        if KINDS[kind] != "card" or (12 <= len(digits) <= 19 and luhn(digits)):
            start, end = trimmed(tokens)
            out.append((start, kind, end, KINDS[kind]))
    return [s for s in out if s[0] < s[2]]


# ---- labelled rows -----------------------------------------------------------------------------


def with_check_digit(digits: str) -> str:
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def made_row(rng: random.Random) -> tuple[str, list[Span]]:
    """A text from a template and its true spans: personal data in forms that the fixed patterns take or miss, or other
    tokens with digits or @, which are told apart by how they were made and not by the patterns."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    n = lambda low, high: str(rng.randrange(low, high))
    letters = lambda low, high: "".join(rng.choices("aeiourstlnmdécü" if rng.random() < 0.15 else "aeiourstlnmd", k=rng.randrange(low, high)))
    word = lambda: rng.choice((letters, lambda a, b: letters(a, b).title()))(2, 9)
    sep, host = rng.choice(".-/"), rng.choice(("localhost", letters(2, 9), letters(2, 6) + n(1, 30), letters(2, 6) + "-" + letters(2, 6)))
    name = letters(1, 8) + rng.choice(("", d(1), d(2), "." + letters(1, 8), "_" + letters(1, 8), "." + d(2), "-" + letters(1, 8), "+" + letters(2, 6)))
    area = lambda: n(2, 10) + d(2)
    kind = rng.choice((0, 1, 2, 3, 3, None, None, None, None, None))
    if kind == 0:
        made = rng.choice((f"{name}@{host}", f"{name}@{host}", f"{name}@{letters(2, 8)}.{rng.choice(('com', 'org', 'de', 'example.com'))}", f"{name}ü{letters(1, 5)}@ü{letters(2, 8)}.{letters(2, 4)}"))
    elif kind == 1:
        h = lambda: f"{rng.randrange(1, 65536):x}"
        made = rng.choice((".".join(n(0, 256) for _ in range(4)), ":".join(h() for _ in range(8)), f"2001:db8::{h()}:{h()}:{h()}", f"fe80::{h()}:{h()}:{h()}:{h()}"))
    elif kind == 2:
        c = with_check_digit(rng.choice("3456") + d(14))
        made = rng.choice((c, f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", f"{c[:4]}/{c[4:8]}/{c[8:12]}/{c[12:]}", f"{c[:4]}_{c[4:8]}_{c[8:12]}_{c[12:]}"))
    elif kind == 3:
        made = rng.choice((
            f"({area()}) {area()}-{d(4)}", f"({area()}) {area()}-{d(4)}", f"({area()}){area()}-{d(4)}", f"({area()}) {area()}.{d(4)}", f"{area()}-{area()}-{d(4)}", f"{area()}.{area()}.{d(4)}", f"1-{area()}-{area()}-{d(4)}",
            f"+{n(1, 99)} ({area()}) {area()}-{d(4)}", f"+{n(1, 99)} {d(3)} {d(3)} {d(4)}", f"+{n(10, 99)}/{d(3)}/{d(7)}", f"0{area()} {area()} {d(4)}", f"0{d(rng.choice((2, 3)))}{sep}{d(7)}", f"(0{d(2)}) {d(7)}", f"0{n(1, 10)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ))
    else:
        made = rng.choice((
            f"{n(0, 20)}.{n(0, 20)}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 40)}", f"v{n(0, 9)}.{n(0, 30)}", f"{n(1800, 2030)}", f"{n(1, 10000)}", f"{n(1, 100)} %", f"{n(1, 100)}%", f"${n(1, 900)},{d(3)}.{d(2)}", f"{n(1, 900)}.{d(2)}", f"{n(1, 30)},{d(3)},{d(3)}",
            f"{n(1900, 2030)}-{n(10, 13)}-{n(10, 31)}", f"0{n(1, 10)}.{n(10, 13)}.{n(1900, 2030)}", f"{n(1, 13)}/{n(1, 31)}/{n(1900, 2030)}", f"{n(10, 24)}:{n(10, 60)}", f"0{n(1, 10)}:{n(10, 60)}:{n(10, 60)}", f"{n(1900, 2000)}-{n(2000, 2030)}", f"{n(1, 90)}-{n(90, 400)}",
            f"[{n(1, 200)}]", f"({n(1800, 2030)})", f"({n(1800, 2030)}) {n(1, 90)}-{n(90, 400)}", f"({n(1, 99)}) {n(1, 90)}", f"{n(1, 30)}th", f"{word()}{n(1, 100)}", f"#{d(5)}", f"#{d(4)}-{d(6)}", f"{d(3)}-{d(2)}-{d(4)}", f"978-{n(0, 10)}-{d(2)}-{d(6)}-{n(0, 10)}",
            f'"{rng.randrange(1 << 159, 1 << 160):x}"', f"{rng.randrange(1 << 127, 1 << 128):x}", f"{d(8)}", f"{d(10)}", f"{d(13)}", f"1{d(15)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{n(100, 999)} {n(100, 999)} {n(1000, 9999)}", f"{n(10, 99)} {n(10, 99)} {n(10, 99)} {n(10, 99)}",
            f"{d(8)}-{d(4)}-{d(4)}-{d(4)}-{d(12)}", f"{n(1, 40)} x {n(1, 40)}", f"{n(1, 9)}/{n(2, 9)}", f"-{n(1, 90)}.{d(6)}, {n(1, 90)}.{d(6)}", f"https://{letters(2, 8)}.org/{n(1, 9999)}/{letters(2, 8)}", f"{letters(3, 8)}.html?id={n(1, 99999)}",
            f"@{name}", f"@{word()}", "@", f"{n(1, 9)} @ {n(1, 99)}", f"{word()}@", f"{letters(2, 8)}@{n(1, 30)}", f"@{letters(2, 8)}:", f"{n(1, 20)}.", f"{n(1, 9)}.{n(0, 9)}.", f"{n(0, 9)}.{n(0, 9)}.{n(0, 9)}.{n(300, 999)}", f"{n(1, 999)} {n(1, 999)}", f"0.{d(4)}", f"00{d(4)}",
        ))
    lead, tail = rng.choice(("", "", "", "(", "<", '"')), rng.choice(("", "", "", ".", ",", ";", "###", "!"))
    tail = {"(": ")", "<": ">", '"': '"'}.get(lead, "") + tail
    head = "".join(word() + rng.choice((" ", " ", " ", ", ", ": ", "\n")) for _ in range(rng.randrange(4)))
    start = len(head) + len(lead)
    spans = [] if kind is None else [(start, kind, start + len(made), KINDS[kind])]
    return head + lead + made + tail + "".join(" " + word() for _ in range(rng.randrange(4))), spans


def made_runs(rows: int = MADE_ROWS, seed: int = 0) -> list[tuple[list, list]]:
    """(features, tags) of the open runs of made rows, the same in every call."""
    rng = random.Random(seed)
    made = [made_row(rng) for _ in range(rows)]
    return [([item[3] for item in run], tags_of(run, spans)) for text, spans in made for run in open_runs(text)]


# ---- on tables ---------------------------------------------------------------------------------


def labelled_runs(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, longest_run: int = LONGEST_RUN, max_runs: int = MAX_RUNS) -> list[tuple[list, list]]:
    """The labelled table: made rows, and runs of at most ``sample_rows`` texts that may hold personal data, taken in order
    of a hash of the text.

    Of the texts only runs are taken of which the fixed patterns cover every token: their tags are sure. What the patterns
    leave uncovered may be personal data in a form they miss, so it counts neither as inside nor as outside; "outside" is
    learnt from made rows alone. Runs over ``longest_run`` tokens are not trained on, and of all runs ``max_runs`` at most,
    the first by a hash, reach the driver. These are bounds of the training sample only.
    """
    text = S.col(f"`{text_col}`")
    seen = docs.filter(text.rlike(LIKELY)).select(text.alias("text"), S.xxhash64(text).alias("hash"))
    # Only hashes are ordered and reach the driver; equal texts count once.
    picked = [r.hash for r in seen.select("hash").distinct().orderBy("hash").limit(sample_rows).collect()]

    @S.pandas_udf("array<struct<features:array<array<string>>,tags:array<int>>>")
    def runs_of(texts):
        import pandas as pd

        out = []
        for t in texts:
            spans = base_spans(t)
            tagged = [(run, tags_of(run, spans)) for run in open_runs(t) if len(run) <= longest_run]
            out.append([{"features": [item[3] for item in run], "tags": tags} for run, tags in tagged if all(tags)])
        return pd.Series(out)

    texts = seen.filter(S.col("hash").isin(picked)).groupBy("hash").agg(S.min("text").alias("text"))
    runs = texts.select("hash", S.posexplode(runs_of("text")).alias("at", "run"))
    rows = runs.orderBy(S.xxhash64("hash", "at"), "hash", "at").limit(max_runs).collect()
    return made_runs() + [(r.run.features, r.run.tags) for r in sorted(rows, key=lambda r: (r.hash, r.at))]


def find_personal_data(docs: DataFrame, model: dict, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with arrays ``_base`` and ``_field`` of (start, rank, end, kind), code points, end exclusive.

    ``_base`` holds the fixed patterns. ``_field`` adds the spans of runs whose best path leads "all outside" by
    ``margin`` or more; a span that overlaps a base span adds nothing and is left out. NULL text is empty and holds
    nothing, equal rows get equal spans, an empty table stays empty, other columns pass through
    but for columns of these two names. Whole texts are
    read, batch by batch, in the task that holds them; the model is small.
    """
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"

    @S.pandas_udf(f"base {kind}, field {kind}")
    def find(texts):
        import pandas as pd

        named = lambda spans: [dict(zip(("start", "rank", "end", "kind"), s)) for s in spans]
        base = [base_spans(t) for t in texts]
        runs = [(i, run) for i, t in enumerate(texts) for run in open_runs(t)]
        field: list[list[Span]] = [[] for _ in base]
        for (i, run), (tags, lead) in zip(runs, viterbi(model, [[item[3] for item in run] for _, run in runs])):
            if lead >= margin:
                field[i] += [s for s in field_spans(run, tags) if not any(b[0] < s[2] and b[2] > s[0] for b in base[i])]
        return pd.DataFrame({"base": [named(b) for b in base], "field": [named(f) for f in field]})

    found = docs.select(S.struct("*").alias("row"), find(S.coalesce(S.col(f"`{text_col}`"), S.lit(""))).alias("found"))
    others = [S.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("_base", "_field")]
    return found.select(*others, S.col("found.base").alias("_base"), S.col("found.field").alias("_field"))
