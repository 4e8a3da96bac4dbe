"""Secret scan with multipart credential linking. Native columns only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as S

from pagewright.functions.sql import Expr, expr, fn as F
from pagewright.llm.common import let, running

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base kinds in their order: pattern without failing matches of the runs, and the group whose length decides.
#: A run shorter than asked for can't hold a longer one, so the length stands in the pattern of runs.
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))

BREAK = r"\n[\x20\t\r]*\n"
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Parts of a credential that mean little alone, and what may complete them; the first that fits at a place wins.
PARTS = {
    "secret": ASSIGN[4:],
    "access": r"AKIA[A-Z0-9]{16,}",
    "ident": rf"(?:username|user_?id|user|login|account|client_?id|access_?key_?id){_VALUE}[A-Za-z0-9._@+-]{{3,}}",
    "endpoint": rf"(?:(?:https?|ftps?|ssh|ldaps?|amqps?|redis|mongodb|mysql|postgres|postgresql)://[A-Za-z0-9._~:/?@%&=+-]+|(?:hostname|host|endpoint|server|base_?url){_VALUE}[A-Za-z0-9.:/_-]{{4,}})",
    "key": rf"(?:(?:pwd|passphrase|credentials?|private_?key|auth_?key){_VALUE}[A-Za-z0-9+/_.=-]{{6,}}|[A-Za-z0-9+/_-]{{20,}}=*)",
    "break": BREAK,
}
COMBINED = "(?i)" + "|".join(f"({p})" for p in (ASSIGN[4:].replace("(password", "(?:password").replace("([A-Z", "(?:[A-Z"), *list(PARTS.values())[1:]))
#: A weak part of the left kind counts if one of the right kinds lies near in its scope.
LINKS = {"key": ("ident", "access", "endpoint"), "ident": ("key", "secret"), "endpoint": ("key", "secret")}
RANK = {"assign": 0, "access": 1, "hex": 2, "key": 3, "ident": 4, "endpoint": 5}
NEAR = 200  # characters between two parts that belong together
SHORTEST = 8  # of any part, in characters
#: No more parts than this begin within NEAR characters of another, parts don't overlap.
REACH = NEAR // SHORTEST + 2


def with_matches(docs: DataFrame, name: str, text: Expr, pattern: str) -> DataFrame:
    """Column ``name``: the leftmost non-overlapping matches as structs (start, end, m, scope), in order.

    Places are code points, end exclusive; they follow from the pieces between the matches, whose lengths are
    added up. ``scope`` counts the matches before that begin with a line feed.
    """
    docs = docs.withColumn("_ms", F.regexp_extract_all(text, pattern, 0).col)
    ms = F.col("_ms")
    # A text without matches is not split; the pieces of the others are read once.
    pieces = F.when(F.size(ms) == 0, Expr("array()")).otherwise(F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p)))
    docs = docs.withColumn("_gaps", F.slice(pieces, 1, F.greatest(F.size(ms), 1)).col)
    plus = lambda a, x: a + x
    lengths = F.zip_with(ms, F.col("_gaps"), lambda m, g: g + F.char_length(m))
    starts = F.zip_with(running(lengths, plus), F.col("_gaps"), lambda before, g: (before + g).cast("int"))
    breaks = F.transform(ms, lambda m: F.when(F.startswith(m, "\n"), 1).otherwise(0))
    scopes = F.transform(running(breaks, plus), lambda n: n.cast("int")) if BREAK in pattern else F.transform(ms, lambda m: F.lit(0))
    placed = F.zip_with(ms, starts, lambda m, at: F.struct(at.alias("start"), (at + F.char_length(m)).alias("end"), m.alias("m")))
    whole = F.zip_with(placed, scopes, lambda x, n: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), n.alias("scope")))
    none = Expr("CAST(array() AS array<struct<start:int,end:int,m:string,scope:int>>)")
    return docs.withColumn(name, F.when(F.size(ms) == 0, none).otherwise(whole).col).drop("_ms", "_gaps")


def named(matches: str, kind, ranks: dict[str, int]) -> Expr:
    """Spans (start, rank, end, kind, scope) of the matches that ``kind`` names; the others are dropped."""
    rank = lambda k: Expr("CASE " + " ".join(f"WHEN {k.text} = '{n}' THEN {r}" for n, r in ranks.items()) + " END")
    spans = F.transform(F.col(matches), lambda s: F.struct(s["start"].alias("start"), kind(s["m"]).alias("kind"), s["end"].alias("end"), s["scope"].alias("scope")))
    spans = F.filter(spans, lambda s: s["kind"].isNotNull())
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["scope"].alias("scope")))


def with_base_spans(docs: DataFrame, text: Expr) -> DataFrame:
    """Column ``_base``: all spans of the base kinds, by start, then kind."""
    for kind, pattern, group, least in BASE:
        docs = with_matches(docs, f"_m_{kind}", text, pattern)
        long_enough = lambda m, k=kind, p=pattern, g=group, n=least: F.when(F.char_length(F.regexp_extract(m, p, g)) >= n, k)
        docs = docs.withColumn(f"_s_{kind}", named(f"_m_{kind}", long_enough, RANK).col).drop(f"_m_{kind}")
    every = [f"_s_{k[0]}" for k in BASE]
    return docs.withColumn("_base", F.array_sort(F.concat(*map(F.col, every))).col).drop(*every)


def part_kind(m: Expr) -> Expr:
    """Kind of a match of COMBINED, told from the match itself; NULL for breaks and for runs that look like words."""
    starts = lambda name: F.rlike(m, rf"^(?i:{PARTS[name]})")
    mixed = F.rlike(m, "[0-9]") & F.rlike(m, "[A-Z]") & F.rlike(m, "[a-z]")
    named = F.rlike(m, r"^(?i:pwd|passphrase|credential|private_?key|auth_?key)[^:=]*[:=]")
    return (
        F.when(F.startswith(m, "\n"), None).when(starts("secret"), "secret").when(starts("access"), "access")
        .when(starts("ident"), "ident").when(starts("endpoint"), "endpoint").when(named | mixed, "key")
    )


def with_linked_spans(docs: DataFrame, text: Expr) -> DataFrame:
    """Column ``_linked``: weak parts with a complementary part at most NEAR characters off, no blank line between.

    An interval join along the sorted parts: parts don't overlap and have a least length, so all partners
    of a part stand within REACH places of it.
    """
    docs = with_matches(docs, "_m", text, COMBINED)
    docs = docs.withColumn("_parts", named("_m", part_kind, RANK).col).drop("_m")

    def complete(p: Expr, i: Expr) -> Expr:
        around = F.slice(Expr("_parts"), F.greatest(i + (1 - REACH), 1), 2 * REACH + 1)
        needs = Expr("CASE " + " ".join(f"WHEN {p['kind'].text} = '{k}' THEN array({', '.join(map(repr, v))})" for k, v in LINKS.items()) + " END")
        near = lambda q: (q["scope"] == p["scope"]) & (q["start"] - p["end"] <= NEAR) & (p["start"] - q["end"] <= NEAR)
        return p["kind"].isin(*LINKS) & F.exists(around, lambda q: near(q) & F.array_contains(needs, q["kind"]))

    weak = F.when(F.size(F.col("_parts")) < 2, F.slice(F.col("_parts"), 1, 0)).otherwise(F.filter(F.col("_parts"), complete))
    return docs.withColumn("_linked", weak.col).drop("_parts")


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_linked``: arrays of (start, rank, end, kind, scope), code points, end exclusive.

    ``_base`` holds the base kinds. ``_linked`` adds identifiers, endpoints and weak secrets, each only where a
    complementary part co-occurs in the same scope (text between blank lines) at most NEAR characters off. NULL
    text is empty and holds nothing, equal rows get equal spans, an empty table gives no rows; other columns
    pass through, but columns of these two names are replaced. Whole texts are read, in the row they stand in; nothing is shuffled.
    """
    whole = docs.select(S.struct("*").alias("row"), S.coalesce(S.col(f"`{text_col}`"), S.lit("")).alias("text"))
    found = with_linked_spans(with_base_spans(whole, F.col("text")), F.col("text"))
    return found.select(*[S.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("_base", "_linked")], "_base", "_linked")


def span_text(spans) -> Expr:
    return F.array_join(F.transform(expr(spans), lambda s: F.concat(s["kind"], ":", s["start"].cast("string"), ":", s["end"].cast("string"))), ",")


def between(text: Expr, cuts: Expr) -> Expr:
    """The pieces of a text from ``at`` to ``to``, for an array of such structs; code points, end exclusive.

    Finding a place in a string takes as long as the place is far, so the text is first dealt into blocks.
    """
    block = 1024

    def pieces(blocks: Expr) -> Expr:
        def piece(c: Expr) -> Expr:
            first, last = Expr(f"CAST({c['at'].text} DIV {block} AS INT)"), Expr(f"CAST({c['to'].text} DIV {block} AS INT)")
            start = Expr(f"CAST({c['at'].text} % {block} + 1 AS INT)")
            inner = F.substring(F.get(blocks, first), start, (c["to"] - c["at"]).cast("int"))
            head = F.substring(F.get(blocks, first), start, block)
            tail = F.coalesce(F.substring(F.get(blocks, last), 1, Expr(f"CAST({c['to'].text} % {block} AS INT)")), "")
            return F.when(c["to"] <= c["at"], "").when(first == last, inner).otherwise(F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail))

        return F.transform(cuts, piece)

    return let(F.regexp_extract_all(text, f"(?s).{{1,{block}}}", 0), pieces)


def redact(text: Expr, spans: Expr, mark: str = "[SECRET]") -> Expr:
    """The text with every span replaced; overlapping spans become one mark. NULL text stays NULL."""

    def masked(sorted_spans: Expr) -> Expr:
        """Each span that begins past all ends before it starts a mark, and the text before it is kept."""
        reached = running(F.transform(sorted_spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        pairs = F.zip_with(sorted_spans, reached, lambda s, at: F.struct(at.alias("at"), s["start"].cast("bigint").alias("to"), (s["start"] >= at).alias("new")))
        fresh = F.filter(pairs, lambda p: p["new"])
        rest = F.struct(F.array_max(F.transform(sorted_spans, lambda s: s["end"].cast("bigint"))).alias("at"), F.char_length(text).cast("bigint").alias("to"), F.lit(True).alias("new"))
        return F.array_join(between(text, F.concat(fresh, F.array(rest))), mark)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.array_sort(spans), masked))


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of its text replaced by a mark; all rows stay."""
    whole = docs.select(S.struct("*").alias("row"), S.col(f"`{text_col}`").alias("text"))
    done = F.when(F.col("text").isNotNull(), redact(F.col("text"), F.concat(F.col("_base"), F.col("_linked")))).col
    return scan_secrets(whole).select(*[done.alias(c) if c == text_col else S.col(f"row.`{c}`").alias(c) for c in docs.columns])
