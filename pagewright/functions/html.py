"""HTML as arrays of tokens, cut by one regular expression per page.

Pages are handled inside their row: a page body is bounded (10 MiB), so its tokens fit in an array
and nothing here needs a shuffle. Quantifiers are possessive, so the matcher neither backtracks nor
recurses on hostile input.
"""

from __future__ import annotations

from pagewright.functions.sql import Expr as Column, fn as F

from pagewright.functions.text import decode_entities, let

# Elements whose content is raw text up to their end tag.
RAW_TEXT = ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp")
# Raw elements whose text still holds character references.
ESCAPABLE_RAW = ("title", "textarea")

_WS = r"\t\n\f\r "
_ATTR_NAME = rf"[^{_WS}/>][^{_WS}/>=]*+"
_ATTR_VALUE = rf"""(?:"[^"]*+"|'[^']*+'|[^{_WS}>"'][^{_WS}>]*+)"""
_ATTRS = rf"(?:[{_WS}/]++|{_ATTR_NAME}(?:[{_WS}]*+=[{_WS}]*+{_ATTR_VALUE}?+)?+)*+"
_RAW = "|".join(RAW_TEXT)
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_BOGUS = r"<[!?][^>]*+(?:>|\z)|</(?![A-Za-z])[^>]*+(?:>|\z)"
_RAW_ELEMENT = rf"<(?i:({_RAW}))(?=[{_WS}/>]){_ATTRS}>.*?(?:</(?i:\1)(?=[{_WS}/>]){_ATTRS}>|\z)"
_TAG = rf"</?[A-Za-z][^{_WS}/>]*+{_ATTRS}>"
# A tag that never closes swallows the rest of the input.
_OPEN_END = r"</?[A-Za-z].*+"

TAGS = rf"(?s){_COMMENT}|{_BOGUS}|{_RAW_ELEMENT}|{_TAG}|{_OPEN_END}"
TOKENS = rf"{TAGS}|[^<]++|<"

_START = rf"(?s)^<([A-Za-z][^{_WS}/>]*+)({_ATTRS})>"


def tag_array(html: Column) -> Column:
    """Tags, comments and raw elements in document order, without plain text."""
    return F.regexp_extract_all(html, F.lit(TAGS), F.lit(0))


def token_array(html: Column) -> Column:
    """Every token in document order."""
    return F.regexp_extract_all(html, F.lit(TOKENS), F.lit(0))


def tag_name(token: Column) -> Column:
    """Lower-cased name of a start or end tag, "" for anything else."""
    return F.lower(F.regexp_extract(token, rf"(?s)^</?([A-Za-z][^{_WS}/>]*+)[{_WS}/>]", 1))


def attribute_text(token: Column) -> Column:
    """The attribute part of a start tag."""
    return F.regexp_extract(token, _START, 2)


def attributes(token: Column) -> Column:
    """ARRAY<STRUCT<name, value>> of a start tag, in order, duplicates kept, references decoded."""
    pairs = F.regexp_extract_all(attribute_text(token), F.lit(rf"(?s){_ATTR_NAME}(?:[{_WS}]*+=[{_WS}]*+{_ATTR_VALUE}?+)?+"), F.lit(0))

    def pair(p: Column) -> Column:
        name = F.regexp_extract(p, rf"(?s)^({_ATTR_NAME})", 1)

        def value(v: Column) -> Column:
            quoted = v.rlike("^[\"']")
            return decode_entities(F.when(quoted, F.substring(v, 2, F.length(v) - 2)).otherwise(v), attribute=True)

        raw = F.regexp_replace(F.substring(p, F.length(name) + 1, 1 << 30), rf"^[{_WS}]*+(?:=[{_WS}]*+)?", "")
        return F.struct(F.lower(name).alias("name"), let(raw, value).alias("value"))

    return F.transform(pairs, pair)


def attribute(token: Column, name: str) -> Column:
    """Value of the first attribute with that name, NULL if absent, "" if it has no value."""
    found = F.filter(attributes(token), lambda a: a["name"] == name)
    return F.get(found, F.lit(0))["value"]


def is_tag(token: Column, name: str) -> Column:
    return token.rlike(rf"(?i)^<{name}[{_WS}/>]")


def raw_inner(token: Column) -> Column:
    """Content of a raw element token."""

    def inner(t: Column) -> Column:
        opened = F.regexp_extract(t, _START, 0)
        rest = F.substring(t, F.length(opened) + 1, 1 << 30)
        return F.regexp_replace(rest, rf"(?is)</(?:{_RAW})(?=[{_WS}/>]){_ATTRS}>\z", "")

    return let(token, inner)
