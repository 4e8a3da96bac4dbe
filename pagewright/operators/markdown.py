"""HTML to Markdown over page tables.

One pass per page, inside the page's row: the token array is folded with ``aggregate`` over a small
state (open elements, active formatting elements, output pieces). Nothing is shuffled and no Python
runs. The fold follows the HTML rules that decide Markdown output: implied ends of p, li, headings and
table cells, void elements, formatting that is reopened after its block closes, text without a body tag.

Not followed: formatting that is closed across a block boundary is closed in place instead of being
rebuilt inside the block, and content misplaced in tables stays where it is written.

"Blank line here", "new line here" and quotes depend on the text before them, so the fold writes marker
characters for them, and a few regular expressions settle the joined text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame

from pagewright.functions import html as H
from pagewright.functions.sql import Expr, choose, fn as F
from pagewright.functions.text import bind, decode_entities, trim_white

# Unicode noncharacters, removed from the input first.
BLANK, LINE, QUOTE, UNQUOTE, OPEN, CLOSE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4", "\ufdd5"
_MARKERS = BLANK + LINE + QUOTE + UNQUOTE + OPEN + CLOSE

# Element classes of the HTML standard.
VOID = "area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split()
FORMATTING = "a b big code em font i nobr s small strike strong tt u".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
CLOSES_P = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup "
    "main menu nav ol p search section summary ul pre listing form hr table li dd dt h1 h2 h3 h4 h5 h6"
).split()
BLOCK_ENDS = (
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer form "
    "header hgroup listing main menu nav ol pre search section summary ul"
).split()
SPECIAL = (
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd "
    "details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object "
    "ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot "
    "th thead title tr track ul wbr xmp"
).split()
SCOPE = "applet body caption html table td th marquee object template".split()
HEAD_ONLY = "html head meta link base basefont bgsound template".split()
TABLE_PARTS = "table tbody thead tfoot tr".split()
CELLS = "td th caption".split()


@dataclass(frozen=True)
class Dialect:
    """What differs between the three Markdown writers."""

    dropped: tuple[str, ...] = ()
    keep_title: bool = False
    heading_end: str = "\n"
    line_break: str = "\n"
    rule: str = BLANK + "---\n"
    emphasis: str = "*"
    images: bool = True
    bullets: tuple[str, ...] = ("- ",)
    number_end: str = ". "
    indent: int = 2
    list_open: str = BLANK
    list_close: str = ""
    fence_open: str = BLANK + "```\n"
    fence_close: str = LINE + "```\n"
    missing_href: str = "#"
    tidy_inline: bool = False
    escapes: tuple[tuple[str, str], ...] = ()


DIALECTS = {
    "fast": Dialect(dropped=("nav", "footer", "aside", "svg")),
    "ai": Dialect(
        keep_title=True,
        heading_end=BLANK,
        line_break="  \n",
        rule=BLANK + "---" + BLANK,
        images=False,
        bullets=("* ", "+ ", "- "),
        list_close=BLANK,
        fence_close="\n```" + BLANK,
        missing_href="",
        tidy_inline=True,
        escapes=((r"([*_])", r"\\$1"),),
    ),
    "browser": Dialect(
        dropped=("nav", "footer", "aside", "svg"),
        keep_title=True,
        heading_end=BLANK,
        line_break="  \n",
        rule=BLANK + "* * *" + BLANK,
        emphasis="_",
        bullets=("-   ",),
        number_end=".  ",
        indent=4,
        list_close=BLANK,
        fence_close=LINE + "```" + BLANK,
        missing_href="",
        tidy_inline=True,
        escapes=((r"([\\*_`\[\]])", r"\\$1"), (r"^(-|\+ |=+|#{1,6} |~~~|>)", r"\\$1"), (r"^([0-9]+)\. ", r"$1\\. ")),
    ),
}

#: Bytes of output after which a buffer is full.
BUFFER = 4096

_BREAKS = r"[ \t\n\f\r]+"


# ---- tokens ------------------------------------------------------------------------------------


def _prepared(html: Expr, d: Dialect) -> Expr:
    """Body tokens as structs: kind (s, e, t), tag, text, and the pieces written at open and close."""
    ignored = r"(?i)^<(?:[!?]|/[^a-z]|(?:script|style|noscript)[\s/>])"
    unmarked = choose(html.rlike(f"[{_MARKERS}]"), F.translate(html, _MARKERS, "")).otherwise(html)
    clean = bind(unmarked, lambda x: choose(x.contains("\r"), F.regexp_replace(x, r"\r\n?", "\n")).otherwise(x))

    def named(t: Expr) -> Expr:
        """The token with its name, so that the name is cut out once; text needs no regular expression for it."""
        return F.struct(t.alias("raw"), choose(t.startswith("<"), H.tag_name(t)).otherwise("").alias("tag"))

    def kept(t: Expr) -> Expr:
        return ~(t["raw"].startswith("<") & ((t["tag"] == "") | t["tag"].startswith("s") | t["tag"].startswith("n")) & t["raw"].rlike(ignored))

    def in_body(all_tokens: Expr) -> Expr:
        head_tags = HEAD_ONLY + ([] if d.keep_title else ["title"])
        opening = F.transform(all_tokens, lambda t: ~choose(t["tag"] == "", t["raw"].rlike(r"^[ \t\n\f\r]+\z")).otherwise(t["tag"].isin(*head_tags)))
        first = F.array_position(opening, True)
        body = bind(
            first, lambda n: choose(n == 0, F.slice(all_tokens, 1, 0)).otherwise(F.slice(all_tokens, F.greatest(n, 1).cast("int"), F.size(all_tokens)))
        )
        unclosed = lambda t: t["raw"].startswith("<") & ~t["raw"].contains(">") & t["raw"].rlike(r"(?s)^</?[A-Za-z](?:[^>]*)\z")
        return F.filter(body, lambda t: ~t["tag"].isin("html", "head", "body") & ~unclosed(t))

    return bind(
        bind(F.filter(F.transform(H.token_array(clean), named), kept), in_body),
        lambda body: F.transform(body, lambda t, i: _token(t["raw"], t["tag"], choose(i > 0, F.get(body, i - 1)["raw"]), d)),
    )


def _token(t: Expr, tag: Expr, previous: Expr, d: Dialect) -> Expr:
    is_text = tag == ""
    is_raw = tag.isin(*H.RAW_TEXT) & ~t.startswith("</")
    inner = choose(is_text, t).otherwise(H.raw_inner(t))
    referring = tag.isin("", *H.ESCAPABLE_RAW) & inner.contains("&")
    text = choose(referring, decode_entities(inner)).otherwise(inner)
    after_pre = lambda x: x.startswith("\n") & F.coalesce(previous.rlike(r"(?i)^<pre[\s>]"), False)
    text = bind(text, lambda x: choose(after_pre(x), F.regexp_replace(x, r"^\n", "")).otherwise(x))
    kind = choose(is_text | is_raw, "t").when(t.startswith("</") & (tag != "br"), "e").otherwise("s")
    mark = (lambda s: OPEN + s) if d.tidy_inline else (lambda s: s)
    unmark = (lambda s: CLOSE + s) if d.tidy_inline else (lambda s: s)

    def link_end() -> Expr:
        target = F.coalesce(H.attribute(t, "href"), d.missing_href)
        return F.concat(unmark("]("), target, ")")

    def image() -> Expr:
        return F.concat("![", F.coalesce(H.attribute(t, "alt"), ""), "](", F.coalesce(H.attribute(t, "src"), ""), ")")

    opens = {"p": BLANK, "br": d.line_break, "hr": d.rule, "a": mark("["), "pre": d.fence_open, "blockquote": BLANK + QUOTE}
    closes = {"p": BLANK, "pre": d.fence_close, "blockquote": UNQUOTE + (BLANK if d.list_close else "")}
    for level, name in enumerate(HEADINGS, 1):
        opens[name], closes[name] = BLANK + "#" * level + " ", d.heading_end
    for names, text_mark in ((("strong", "b"), "**"), (("em", "i"), d.emphasis), (("code",), "`")):
        opens |= dict.fromkeys(names, mark(text_mark))
        closes |= dict.fromkeys(names, unmark(text_mark))
    for name in ("ul", "ol"):
        opens[name], closes[name] = d.list_open, d.list_close
    opened, closed = _lookup(opens, tag), choose(tag == "a", link_end()).otherwise(_lookup(closes, tag))
    if d.images:
        opened = choose(tag == "img", image()).otherwise(opened)

    def made(k: Expr) -> Expr:
        start, words = k == "s", k == "t"
        return F.struct(
            k.alias("kind"),
            choose(words, "").otherwise(tag).alias("tag"),
            choose(words, text).otherwise("").alias("text"),
            choose(start, opened).otherwise("").alias("opened"),
            choose(start, closed).otherwise("").alias("closed"),
            choose(start & tag.isin(*FORMATTING), F.concat(tag, " ", H.attribute_text(t))).otherwise("").alias("key"),
        )

    return bind(kind, made)


def _lookup(texts: dict[str, str], tag: Expr) -> Expr:
    """The text of a tag, "" if it has none: one scan of a constant map instead of a branch per tag."""
    pairs = [x for pair in texts.items() for x in pair]
    return F.coalesce(F.try_element_at(F.map(*pairs), tag), "")


# ---- the fold ----------------------------------------------------------------------------------

_STACK = "array<struct<tag:string,id:int,closed:string,items:int>>"
_ACTIVE = "array<struct<tag:string,id:int,opened:string,closed:string,key:string>>"


def _entry(tag, ident, closed, items=0) -> Expr:
    as_expr = lambda v: v if isinstance(v, Expr) else F.lit(v)
    return F.struct(as_expr(tag).alias("tag"), as_expr(ident).alias("id"), as_expr(closed).alias("closed"), as_expr(items).alias("items"))


def _state(stack, active, out, done, quotes, step) -> Expr:
    return F.struct(
        stack.alias("stack"), active.alias("active"), out.alias("out"), done.alias("done"), quotes.alias("quotes"), step.alias("step")
    )


def _reach(stack: Expr, wanted: Expr, barrier: Expr) -> Expr:
    """1-based depth of the nearest wanted element, 0 if a barrier comes first. Both are functions of a tag."""
    open_here = lambda e: wanted(e["tag"])

    def unblocked(hit: Expr) -> Expr:
        return choose(F.exists(F.slice(stack, 1, hit - 1), lambda e: barrier(e["tag"])), 0).otherwise(hit)

    deeper = bind(F.array_position(F.transform(stack, open_here), True).cast("int"), unblocked)
    # Nearly always it is the innermost element or none; looking up a place costs Spark an exception.
    return choose(open_here(F.get(stack, 0)), 1).when(F.exists(stack, open_here), deeper).otherwise(0)


def _among(*names):
    return lambda tag: tag.isin(*names)


_BUTTON = _among(*SCOPE, "button")
_IN_SCOPE = _among(*SCOPE)
_TABLE = _among("table", "body", "template")


def _pops_before(stack: Expr, tag: Expr) -> Expr:
    """How many open elements a start tag closes."""
    close_p = lambda: _reach(stack, _among("p"), _BUTTON)
    item_stop = _among(*[s for s in SPECIAL if s not in ("address", "div", "p")])
    top_heading = stack[0]["tag"].isin(*HEADINGS)
    return (
        choose(tag == "li", F.greatest(_reach(stack, _among("li"), item_stop), close_p()))
        .when(tag.isin("dd", "dt"), F.greatest(_reach(stack, _among("dd", "dt"), item_stop), close_p()))
        .when(tag.isin(*HEADINGS), choose(top_heading, 1).otherwise(close_p()))
        .when(tag.isin(*CLOSES_P), close_p())
        .when(tag.isin("td", "th"), _reach(stack, _among("td", "th"), _TABLE))
        .when(tag == "tr", _reach(stack, _among("tr"), _TABLE))
        .when(tag.isin("tbody", "thead", "tfoot"), _reach(stack, _among("tbody", "thead", "tfoot"), _TABLE))
        .when(tag == "option", choose(stack[0]["tag"] == "option", 1).otherwise(0))
        .otherwise(0)
    )


def _pops_at_end(stack: Expr, tag: Expr) -> Expr:
    """How many open elements an end tag closes (formatting elements aside)."""
    return (
        choose(tag == "p", _reach(stack, _among("p"), _BUTTON))
        .when(tag == "li", _reach(stack, _among("li"), _among(*SCOPE, "ol", "ul")))
        .when(tag.isin(*HEADINGS), _reach(stack, _among(*HEADINGS), _IN_SCOPE))
        .when(tag.isin("dd", "dt", *BLOCK_ENDS), _reach(stack, lambda x: x == tag, _IN_SCOPE))
        .when(tag.isin("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), _reach(stack, lambda x: x == tag, _TABLE))
        .otherwise(_reach(stack, lambda x: x == tag, _among(*SPECIAL)))
    )


def _join_closed(entries: Expr) -> Expr:
    return F.array_join(F.transform(entries, lambda e: e["closed"]), "")


def _closing(stack: Expr, n: Expr) -> Expr:
    """What the innermost n elements write at their end; mostly it is one element."""
    return choose(n == 1, F.get(stack, 0)["closed"]).otherwise(_join_closed(F.slice(stack, 1, n)))


def _popped(stack: Expr, n: Expr) -> Expr:
    return F.slice(stack, n + 1, F.size(stack))


def _leave_cells(active: Expr, gone: Expr) -> Expr:
    """Formatting opened inside a closed table cell ends with it."""
    cells = F.filter(gone, lambda e: e["tag"].isin(*CELLS))
    return choose((F.size(active) == 0) | (F.size(cells) == 0), active).otherwise(
        F.filter(active, lambda a: ~F.exists(cells, lambda c: c["id"] < a["id"]))
    )


def _emit(state: Expr, piece: Expr):
    """Append a piece; a full buffer moves to ``done`` so that appending stays cheap on long pages."""
    full = F.octet_length(state["out"]) >= BUFFER
    out = choose(full, F.coalesce(piece, "")).otherwise(F.concat(state["out"], F.coalesce(piece, "")))
    done = choose(full, F.array_append(state["done"], state["out"])).otherwise(state["done"])
    return out, done


def _one_line(text: Expr) -> Expr:
    """Runs of white space as one space; most texts have single spaces only, which a search for bytes tells."""
    runs = reduce(or_, (text.contains(x) for x in ("  ", "\n", "\t", "\f", "\r")))
    return choose(runs, F.regexp_replace(text, _BREAKS, " ")).otherwise(text)


def _fold(tokens: Expr, d: Dialect) -> Expr:
    def hidden(stack: Expr) -> Expr:
        return F.exists(stack, lambda e: e["tag"].isin(*d.dropped)) if d.dropped else F.lit(False)

    def in_pre(stack: Expr) -> Expr:
        return F.exists(stack, lambda e: e["tag"] == "pre")

    def reopened(stack: Expr, active: Expr) -> Expr:
        """Active formatting elements that are not open, oldest first, inside the current cell."""
        inner = F.array_max(F.transform(F.filter(stack, lambda e: e["tag"].isin(*CELLS)), lambda e: e["id"]))
        return F.filter(
            active, lambda a: ~F.exists(stack, lambda e: e["id"] == a["id"]) & (a["id"] > F.coalesce(inner, -1))
        )

    def as_is(stack: Expr) -> Expr:
        return F.struct(stack.alias("stack"), F.lit("").alias("text"))

    def reopen(stack: Expr, active: Expr) -> Expr:
        """STRUCT<stack, text> with those elements open again."""

        def go(again: Expr) -> Expr:
            quiet = hidden(stack)
            code = lambda a, text: choose(quiet | ((a["tag"] == "code") & in_pre(stack)), "").otherwise(text)
            entries = F.transform(F.reverse(again), lambda a: _entry(a["tag"], a["id"], code(a, a["closed"])))
            text = F.array_join(F.transform(again, lambda a: code(a, a["opened"])), "")
            return F.struct(F.concat(entries, stack).alias("stack"), text.alias("text"))

        return choose(F.size(active) == 0, as_is(stack)).otherwise(bind(reopened(stack, active), go))

    def text_step(s: Expr, t: Expr) -> Expr:
        def write(r: Expr) -> Expr:
            shown = _one_line(t["text"])
            for pattern, replacement in d.escapes:
                code_free = ~F.exists(r["stack"], lambda e: e["tag"].isin("code", "pre"))
                shown = bind(shown, lambda x: choose(x.rlike(pattern) & code_free, F.regexp_replace(x, pattern, replacement)).otherwise(x))
            shown = choose(in_pre(r["stack"]), t["text"]).otherwise(shown)
            return bind(
                F.concat(r["text"], choose(hidden(r["stack"]), "").otherwise(shown)),
                lambda piece: _state(r["stack"], s["active"], *_emit(s, piece), s["quotes"], s["step"] + 1),
            )

        in_table = s["stack"][0]["tag"].isin(*TABLE_PARTS) & t["text"].rlike(r"^[ \t\n\f\r]*\z")
        return bind(choose(in_table, as_is(s["stack"])).otherwise(reopen(s["stack"], s["active"])), write)

    def start_step(s: Expr, t: Expr) -> Expr:
        tag = t["tag"]

        def after_pops(c: Expr) -> Expr:
            plain_block = tag.isin(*CLOSES_P, "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option")
            ready = choose(plain_block, as_is(c["stack"])).otherwise(reopen(c["stack"], c["active"]))
            return bind(ready, lambda r: pushed(c, r))

        def pushed(c: Expr, r: Expr) -> Expr:
            quiet = hidden(r["stack"]) | (tag.isin(*d.dropped) if d.dropped else F.lit(False))
            silent = quiet | ((tag == "code") & in_pre(r["stack"]))
            top = r["stack"][0]
            lists = F.filter(r["stack"], lambda e: e["tag"].isin("ul", "ol"))
            depth = F.size(lists)
            indent = F.repeat(" " * d.indent, F.greatest(depth - 1, 0))
            number = F.concat((top["items"] + 1).cast("string"), d.number_end)
            bullet = F.lit(d.bullets[0])
            if len(d.bullets) > 1:
                uls = F.size(F.filter(lists, lambda e: e["tag"] == "ul"))
                bullet = F.element_at(F.array(*d.bullets), (F.pmod(F.greatest(uls - 1, 0), len(d.bullets)) + 1).cast("int"))
            item = F.concat(LINE, indent, choose(F.coalesce(F.get(lists, 0)["tag"], "") == "ol", number).otherwise(bullet))
            nested = tag.isin("ul", "ol") & (depth > 0)
            opened = choose(silent, "").when(tag == "li", item)
            closed = choose(silent, "")
            if d.list_close:
                opened = opened.when(nested, LINE)
                closed = closed.when(nested, "")
            opened, closed = opened.otherwise(t["opened"]), closed.otherwise(t["closed"])
            counted = choose(
                tag == "li",
                F.concat(F.array(_entry(top["tag"], top["id"], top["closed"], top["items"] + 1)), F.slice(r["stack"], 2, F.size(r["stack"]))),
            ).otherwise(r["stack"])
            stack = choose(tag.isin(*VOID), r["stack"]).otherwise(F.concat(F.array(_entry(tag, s["step"], closed)), counted))
            # Of equal formatting elements at most three stay active.
            twins = F.filter(c["active"], lambda a: a["key"] == t["key"])
            kept = choose(F.size(twins) < 3, c["active"]).otherwise(F.filter(c["active"], lambda a: a["id"] != F.get(twins, 0)["id"]))
            item_active = F.struct(
                tag.alias("tag"), s["step"].alias("id"), t["opened"].alias("opened"), t["closed"].alias("closed"), t["key"].alias("key")
            )
            active = choose(t["key"] != "", F.array_append(kept, item_active)).otherwise(c["active"])
            quotes = choose(
                tag == "blockquote", F.greatest(s["quotes"], F.size(F.filter(r["stack"], lambda e: e["tag"] == "blockquote")) + 1)
            ).otherwise(s["quotes"])
            return bind(
                F.concat(c["text"], r["text"], opened),
                lambda piece: _state(stack, active, *_emit(s, piece), quotes, s["step"] + 1),
            )

        def pops(n: Expr) -> Expr:
            gone = F.slice(s["stack"], 1, n)
            return choose(
                n == 0, F.struct(s["stack"].alias("stack"), s["active"].alias("active"), F.lit("").alias("text"))
            ).otherwise(
                F.struct(
                    _popped(s["stack"], n).alias("stack"), _leave_cells(s["active"], gone).alias("active"), _closing(s["stack"], n).alias("text")
                )
            )

        # A second link start ends the open link first.
        open_link = (tag == "a") & F.exists(s["active"], lambda a: a["tag"] == "a")
        cleared = choose(open_link, end_formatting(s, "a")).otherwise(bind(_pops_before(s["stack"], tag), pops))
        return bind(cleared, after_pops)

    def end_formatting(s: Expr, tag) -> Expr:
        """STRUCT<stack, active, text> after the last active element with that tag ends."""

        def close(a: Expr) -> Expr:
            rest = F.filter(s["active"], lambda x: x["id"] != a["id"])
            deeper = F.array_position(F.transform(s["stack"], lambda e: e["id"]), a["id"]).cast("int")
            depth = choose(F.get(s["stack"], 0)["id"] == a["id"], 1).otherwise(deeper)

            def apply(k: Expr) -> Expr:
                block_inside = F.exists(F.slice(s["stack"], 1, k - 1), lambda e: e["tag"].isin(*SPECIAL))
                return (
                    choose(k == 0, F.struct(s["stack"].alias("stack"), rest.alias("active"), F.lit("").alias("text")))
                    .when(
                        block_inside,
                        F.struct(
                            F.filter(s["stack"], lambda e: e["id"] != a["id"]).alias("stack"),
                            rest.alias("active"),
                            F.get(s["stack"], k - 1)["closed"].alias("text"),
                        ),
                    )
                    .otherwise(F.struct(_popped(s["stack"], k).alias("stack"), rest.alias("active"), _closing(s["stack"], k).alias("text")))
                )

            return bind(depth, apply)

        return bind(F.element_at(F.filter(s["active"], lambda x: x["tag"] == tag), -1), close)

    def end_step(s: Expr, t: Expr) -> Expr:
        tag = t["tag"]

        def plain(n: Expr) -> Expr:
            gone = F.slice(s["stack"], 1, n)
            lone_p = choose((tag == "p") & (n == 0) & ~hidden(s["stack"]), BLANK).otherwise("")
            return choose(
                n == 0, F.struct(s["stack"].alias("stack"), s["active"].alias("active"), lone_p.alias("text"))
            ).otherwise(
                F.struct(
                    _popped(s["stack"], n).alias("stack"), _leave_cells(s["active"], gone).alias("active"), _closing(s["stack"], n).alias("text")
                )
            )

        formatting = tag.isin(*FORMATTING) & F.exists(s["active"], lambda a: a["tag"] == tag)
        result = choose(formatting, end_formatting(s, tag)).otherwise(bind(_pops_at_end(s["stack"], tag), plain))
        return bind(
            result,
            lambda r: bind(r["text"], lambda piece: _state(r["stack"], r["active"], *_emit(s, piece), s["quotes"], s["step"] + 1)),
        )

    def step(s: Expr, t: Expr) -> Expr:
        return choose(t["kind"] == "t", text_step(s, t)).when(t["kind"] == "s", start_step(s, t)).otherwise(end_step(s, t))

    empty = _state(
        F.array(_entry("body", -1, "")).cast(_STACK),
        F.array().cast(_ACTIVE),
        F.lit(""),
        F.array().cast("array<string>"),
        F.lit(0),
        F.lit(0),
    )

    def finish(s: Expr) -> Expr:
        text = F.concat(F.array_join(F.array_append(s["done"], s["out"]), ""), _join_closed(s["stack"]))
        return F.struct(text.alias("text"), s["quotes"].alias("quotes"))

    kind = "struct<stack:%s,active:%s,out:string,done:array<string>,quotes:int,step:int>" % (_STACK, _ACTIVE)
    return F.aggregate(tokens, empty.cast(kind), step, finish)


# ---- settling markers --------------------------------------------------------------------------


def _settle(text: Expr) -> Expr:
    """Turn blank-line and new-line markers into newlines, given the text before each of them."""
    b, l, either = BLANK, LINE, f"[{BLANK}{LINE}]"
    before = f"(?<![\n{BLANK}{LINE}])"
    for pattern, replacement in (
        (f"{l}++", l),
        (f"{either}*{b}{either}*+", b),
        (rf"\A{either}", ""),
        (f"{before}\n?{b}", "\n\n"),
        (f"{before}(\n\n+){b}", "$1"),
        (f"{before}{l}", "\n"),
        (either, ""),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _quotes(text: Expr, levels: Expr) -> Expr:
    """Render quotes from the innermost level outwards."""

    def render(piece: Expr) -> Expr:
        inner = trim_white(_settle(F.translate(piece, QUOTE + UNQUOTE, "")))
        return bind(inner, lambda x: choose(x == "", "").otherwise(F.concat(F.regexp_replace(x, "(?dm)^", "> "), "\n")))

    def level(s: Expr) -> Expr:
        pieces = F.split(s, f"(?={QUOTE})|(?<={UNQUOTE})")
        innermost = rf"(?s)\A{QUOTE}[^{QUOTE}{UNQUOTE}]*+{UNQUOTE}\z"
        return F.array_join(F.transform(pieces, lambda p: choose(p.rlike(innermost), render(p)).otherwise(p)), "")

    return choose(levels == 0, text).otherwise(F.aggregate(F.sequence(1, F.greatest(levels, 1)), text, lambda s, _: level(s)))


def _tidy(text: Expr) -> Expr:
    """Empty inline marks vanish and spaces at their inner edges move outside."""
    mark = r"(?:\*\*|[*_`])"
    for pattern, replacement in (
        (rf"{OPEN}({mark}){CLOSE}\1", ""),
        (rf"{OPEN}\[{CLOSE}\]\([^)]*\)", ""),
        (rf"{OPEN}({mark}) +", rf" {OPEN}$1"),
        (rf" +{CLOSE}({mark})", rf"{CLOSE}$1 "),
        (f"[{OPEN}{CLOSE}]", ""),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _collapse(text: Expr) -> Expr:
    """At most one blank line in a row, nothing blank at the ends; code blocks are not exempt."""
    blank = "[\\t\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
    lines = F.regexp_replace(text, f"(?<=\\n){blank}++(?=\\n)", "")
    return trim_white(F.regexp_replace(lines, "\\n{3,}", "\n\n"))


def markdown(html: Expr, dialect: str = "fast") -> Expr:
    """H9 (``fast``), H10 (``ai``), H11 (``browser``) as an expression over one page's HTML."""
    d = DIALECTS[dialect]
    source = html
    if dialect == "ai":
        source = F.regexp_replace(source, r"(?is)<\s*(script|style|noscript)[^>]*>.*?</\s*\1\s*>", "")

    def settle(r: Expr) -> Expr:
        text = _settle(_quotes(_tidy(r["text"]) if d.tidy_inline else r["text"], r["quotes"]))
        return _collapse(text)

    return bind(_fold(_prepared(source, d), d), settle)


def page_markdown(pages: DataFrame, page_id: str = "page_id", html: str = "html", dialect: str = "fast") -> DataFrame:
    """(page_id, markdown), one row per page."""
    return pages.select(page_id, markdown(F.col(html), dialect).alias("markdown").col)
