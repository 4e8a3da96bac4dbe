"""Text helpers as native column expressions (no Python runs per row)."""

from __future__ import annotations

from html.entities import html5

from pagewright.functions.sql import Expr as Column, fn as F

# Whitespace as Unicode White_Space, and the wider set of str.strip().
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
STRIP_SPACE = WHITE_SPACE + "\x1c\x1d\x1e\x1f"

# Numeric references 128-159 are read as windows-1252.
WINDOWS_1252 = {
    n: bytes([n]).decode("windows-1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}

# The few names that make up nearly all references come first: a map lookup scans in order.
_FREQUENT = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;", "mdash;", "ndash;", "hellip;", "rsquo;", "raquo;")
_NAMED = {name: html5[name] for name in _FREQUENT} | html5


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression so that ``body`` can use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(value: Column, body) -> Column:
    """``let`` without its copy: the value is the start of a fold over nothing, and ``body`` its end.

    ``let`` copies what ``body`` returns with all that is inside, which a fold would pay for its whole state at every step.
    """
    return F.aggregate(F.array(), value, lambda bound, _: bound, body)


def trim_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIP_SPACE))


def _lookup(values: dict[str, str]):
    """A function from key column to value column over a fixed table; NULL for an unknown key.

    Both lists are constant expressions, which the optimizer folds once per query.
    """
    keys = F.split(F.lit("\x1e".join(values)), "\x1e")
    items = F.split(F.lit("\x1e".join(values.values())), "\x1e")
    return lambda key: let(F.array_position(keys, key), lambda i: F.when(i > 0, F.get(items, (i - 1).cast("int"))))


def code_point(n: Column) -> Column:
    """The character of an integer code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric_reference(digits: Column, base: int) -> Column:
    # More than seven significant digits is out of range in either base.
    significant = F.regexp_replace(digits, "^0+", "")
    number = F.when(F.length(significant) > 7, F.lit(0x110000)).otherwise(
        F.coalesce(F.conv(significant, base, 10).cast("long"), F.lit(0))
    )
    low = _lookup({str(k): v for k, v in WINDOWS_1252.items()})

    def render(n: Column) -> Column:
        bad = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        return (
            F.when(bad, F.lit("\ufffd"))
            .when(n.between(0x80, 0x9F), F.coalesce(low(n.cast("string")), code_point(n)))
            .otherwise(code_point(n))
        )

    return let(number, render)


def _reference_piece(piece: Column, attribute: bool) -> Column:
    """One piece that starts with '&': decode the reference at its head, keep the rest."""
    named = _lookup(_NAMED)

    def by_name(run: Column) -> Column:
        return let(named(run), lambda exact: replace_name(run, exact))

    def replace_name(run: Column, exact: Column) -> Column:
        rest = F.substring(piece, F.length(run) + 2, 1 << 30)
        if attribute:
            blocked = ~run.endswith(";") & rest.startswith("=")
            return F.when(exact.isNull() | blocked, piece).otherwise(F.concat(exact, rest))
        # The longest known name without a semicolon has six letters.
        prefixes = F.filter(
            F.transform(F.sequence(F.lit(6), F.lit(2), F.lit(-1)), lambda n: F.substring(run, 1, n)),
            lambda p: (F.length(p) < F.length(run)) & named(p).isNotNull(),
        )
        shorter = let(
            F.get(prefixes, F.lit(0)),
            lambda p: F.when(p.isNull(), piece).otherwise(F.concat(named(p), F.substring(piece, F.length(p) + 2, 1 << 30))),
        )
        return F.when(exact.isNotNull(), F.concat(exact, rest)).otherwise(shorter)

    def numeric(pattern: str, base: int) -> Column:
        head = F.regexp_extract(piece, pattern, 0)
        return F.concat(
            _numeric_reference(F.regexp_extract(piece, pattern, 1), base),
            F.substring(piece, F.length(head) + 1, 1 << 30),
        )

    decimal, hexadecimal, name = r"^&#([0-9]+);?", r"^&#[xX]([0-9a-fA-F]+);?", r"^&([A-Za-z0-9]+;?)"
    return (
        F.when(piece.rlike(decimal), numeric(decimal, 10))
        .when(piece.rlike(hexadecimal), numeric(hexadecimal, 16))
        .when(piece.rlike(name), let(F.regexp_extract(piece, name, 1), by_name))
        .otherwise(piece)
    )


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """Character references to characters, in text or (``attribute=True``) in attribute values."""

    def decode(text: Column) -> Column:
        pieces = F.transform(F.split(text, "(?=&)"), lambda p: _reference_piece(p, attribute))
        return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)

    return let(c, decode)


# ---- percent encoding -------------------------------------------------------------------------

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
UNRESERVED = _ALNUM + "-_.~"
PATH_SAFE = UNRESERVED + "$&+,/:;=@"
HOST_SAFE = UNRESERVED + "!$&'()*+,;=:[]<>\""
USER_SAFE = UNRESERVED + "$&+,;="


def bad_escape(c: Column) -> Column:
    return c.rlike("%(?![0-9A-Fa-f]{2})")


def percent_decode(c: Column) -> Column:
    """%XX to text; a plus sign and a broken escape stay as they are."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.url_decode(safe)).otherwise(c)


def form_decode(c: Column) -> Column:
    """Query component to text: plus is a space, broken escapes stay."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def percent_reencode(c: Column, safe: str) -> Column:
    """Decode %XX to bytes, then write every byte outside ``safe`` as upper-case %XX."""
    units = F.regexp_extract_all(c, F.lit("(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    as_hex = F.array_join(
        F.transform(
            units,
            lambda u: F.when(F.length(u) == 3, F.upper(F.substring(u, 2, 2))).otherwise(F.hex(F.encode(u, "UTF-8"))),
        ),
        "",
    )
    kept = _lookup({f"{ord(ch):02X}": ch for ch in safe})
    return F.array_join(
        F.transform(
            F.regexp_extract_all(as_hex, F.lit("[0-9A-F]{2}"), F.lit(0)),
            lambda b: F.coalesce(kept(b), F.concat(F.lit("%"), b)),
        ),
        "",
    )
