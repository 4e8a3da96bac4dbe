"""Spark SQL expressions as text.

The per-URL and per-page rules are large expressions full of higher-order functions. Built node by
node through the Column API they cost thousands of calls into the JVM before a job starts; as one
SQL text they cost one ``F.expr``. ``fn`` spells any SQL function, Python lambdas become SQL lambdas.
"""

from __future__ import annotations

import inspect
import itertools

from pyspark.sql import Column, functions as F

_fresh = itertools.count()


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\0", "\\0") + "'"


def _sql(value) -> str:
    if isinstance(value, Expr):
        return value.text
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return _quote(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value) if abs(value) < 1 << 31 else f"{value}L"
    if callable(value):
        names = [f"v{next(_fresh)}" for _ in inspect.signature(value).parameters]
        head = names[0] if len(names) == 1 else f"({', '.join(names)})"
        return f"{head} -> {_sql(value(*map(Expr, names)))}"
    raise TypeError(f"no SQL form for {value!r}")


def _binary(op: str):
    return lambda self, other: Expr(f"({self.text} {op} {_sql(other)})")


class Expr:
    """A SQL expression; operators and methods follow ``pyspark.sql.Column``."""

    __hash__ = None

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    __eq__, __ne__ = _binary("="), _binary("<>")
    __lt__, __le__, __gt__, __ge__ = _binary("<"), _binary("<="), _binary(">"), _binary(">=")
    __and__, __or__ = _binary("AND"), _binary("OR")
    __add__, __sub__, __mul__ = _binary("+"), _binary("-"), _binary("*")

    def __rsub__(self, other):
        return Expr(f"({_sql(other)} - {self.text})")

    def __invert__(self):
        return Expr(f"(NOT {self.text})")

    def __getitem__(self, key):
        return Expr(f"{self.text}.{key}" if isinstance(key, str) else f"{self.text}[{_sql(key)}]")

    def alias(self, name: str) -> Expr:
        return Expr(self.text, name)

    def cast(self, kind: str) -> Expr:
        return Expr(f"CAST({self.text} AS {kind})")

    def isNull(self):
        return Expr(f"({self.text} IS NULL)")

    def isNotNull(self):
        return Expr(f"({self.text} IS NOT NULL)")

    def isin(self, *values):
        return Expr(f"({self.text} IN ({', '.join(map(_sql, values))}))")

    def between(self, low, high):
        return Expr(f"({self.text} BETWEEN {_sql(low)} AND {_sql(high)})")

    def rlike(self, pattern):
        return fn.rlike(self, pattern)

    def contains(self, other):
        return fn.contains(self, other)

    def startswith(self, other):
        return fn.startswith(self, other)

    def endswith(self, other):
        return fn.endswith(self, other)

    @property
    def col(self) -> Column:
        """The finished Column, named if the expression is."""
        made = F.expr(self.text)
        return made.alias(self.name) if self.name else made


class _Case(Expr):
    def __init__(self, branches):
        self.branches = branches
        super().__init__("(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + " END)")

    def when(self, condition, value) -> _Case:
        return _Case(self.branches + [(_sql(condition), _sql(value))])

    def otherwise(self, value) -> Expr:
        return Expr(f"{self.text[:-5]} ELSE {_sql(value)} END)")


class _Choice(Expr):
    """``_Case`` as nested IFs: inside lambdas Spark looks up each branch of a CASE in a linked list, a third of a fold's time."""

    def __init__(self, branches, last="NULL"):
        self.branches = branches
        super().__init__("".join(f"IF({c}, {v}, " for c, v in branches) + last + ")" * len(branches))

    def when(self, condition, value) -> _Choice:
        return _Choice(self.branches + [(_sql(condition), _sql(value))])

    def otherwise(self, value) -> Expr:
        return Expr(_Choice(self.branches, _sql(value)).text)


def choose(condition, value) -> _Choice:
    """``fn.when`` for lambdas that run for every token; all branches have one type."""
    return _Choice([(_sql(condition), _sql(value))])


class _Functions:
    @staticmethod
    def col(name: str) -> Expr:
        return Expr(name)

    @staticmethod
    def lit(value) -> Expr:
        return Expr(_sql(value))

    @staticmethod
    def when(condition, value) -> _Case:
        return _Case([(_sql(condition), _sql(value))])

    @staticmethod
    def struct(*fields: Expr) -> Expr:
        return Expr("named_struct(" + ", ".join(f"{_quote(f.name)}, {f.text}" for f in fields) + ")")

    def __getattr__(self, name: str):
        return lambda *args: Expr(f"{name}({', '.join(map(_sql, args))})")


fn = _Functions()


def expr(value) -> Expr:
    """An expression from a column name, SQL text or another expression."""
    return value if isinstance(value, Expr) else Expr(value)
