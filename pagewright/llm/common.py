"""Text helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pagewright.functions.sql import Expr, expr, fn as F

#: The white space of all word and line rules: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value, body: Callable[[Expr], Expr]) -> Expr:
    """``body`` over a value that is computed once, however often the body or its lambdas name it."""
    return F.transform(F.array(expr(value)), body)[0]


def ascii_lower(x) -> Expr:
    """A-Z lower-cased, every other character as it is.

    ``lower`` does the same on ASCII and on the small letters of Latin-1; only other texts take the slower way.
    """
    x = expr(x)
    return (
        F.when(F.octet_length(x) == F.char_length(x), F.lower(x))
        .when(F.rlike(x, r"^[\x00-\x7F\xDF-\xFF]*+$"), F.lower(x))
        .otherwise(F.translate(x, UPPER, LOWER))
    )


def words(text) -> Expr:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(F.translate(expr(text), SPACE, " " * len(SPACE)), " "), lambda w: w != "")


#: Numbers that one step of ``running`` folds; folds copy what they have gathered, so they stay short.
FOLD = 512


def running(values, combine: Callable[[Expr, Expr], Expr]) -> Expr:
    """For each of an array of longs that aren't negative, 0 and all before it combined (their sum, their maximum, ...).

    Blocks of 512 are folded each, and so are the blocks' totals, so long arrays take time in proportion.
    """

    def fold(block: Expr) -> Expr:
        start = Expr("named_struct('all', 0L, 'out', CAST(array() AS array<bigint>))")
        return F.aggregate(block, start, lambda a, x: F.struct(combine(a["all"], x).alias("all"), F.concat(a["out"], F.array(a["all"])).alias("out")))

    def blocks(xs: Expr) -> Expr:
        firsts = F.sequence(0, F.greatest(Expr(f"CAST((size({xs.text}) - 1) DIV {FOLD} AS INT)"), 0))
        return let(F.transform(firsts, lambda i: fold(F.slice(xs, i * FOLD + 1, FOLD))), joined)

    def joined(folded: Expr) -> Expr:
        before = fold(F.transform(folded, lambda b: b["all"]))["out"]
        return F.flatten(F.zip_with(folded, before, lambda b, all_before: F.transform(b["out"], lambda x: combine(all_before, x))))

    return let(F.transform(expr(values), lambda x: x.cast("bigint")), blocks)
