"""Small building blocks shared by the scalar functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

WIDE_SPACE = "[\\s\\u00a0\\u202f]"


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Branches of a ``when`` are not covered by Spark's common sub-expression
    elimination, so a regular expression used in several branches would run again in
    each of them.
    """
    return F.transform(F.array(value), body)[0]


def text(c: ColumnOrName) -> Column:
    """The value as text, null as the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, WIDE_SPACE + "+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def any_of(words: Iterable[str]) -> str:
    """A pattern matching any of the literal words."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def has_any(c: Column, words: Iterable[str]) -> Column:
    """True when the text holds one of the words; one pass instead of one per word."""
    return c.rlike(any_of(words))


def _literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else repr(v)


def literal_map(table: dict) -> Column:
    """A small table as one constant map."""
    return F.expr("map(" + ", ".join(_literal(x) for kv in table.items() for x in kv) + ")")


def lookup(c: Column, table: dict) -> Column:
    """Value of a small literal table, null when absent."""
    return F.try_element_at(literal_map(table), c)


def first_contained(c: Column, table: dict) -> Column:
    """Value of the first key, in table order, that the text holds."""
    entries = ", ".join(f"struct({_literal(k)} AS k, {_literal(v)} AS v)" for k, v in table.items())
    return F.get(F.filter(F.expr(f"array({entries})"), lambda e: c.contains(e["k"])), F.lit(0))["v"]


def first_hit(rules: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Ordered rules, first true condition wins."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    assert out is not None
    return out if default is None else out.otherwise(default)


def first_word(c: Column, words: Iterable[str]) -> Column:
    """The first listed word that the text holds (list order, not text order)."""
    return first_contained(c, {w: w for w in words})
