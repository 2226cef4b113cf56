"""Registered queries and the independent SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import FIXTURES, TABLES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its checking statement, if one exists.

    ``@name`` in the statement stands for a fixture; fixtures become leading CTEs.
    """

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


def expand(sql: str) -> str:
    names: list[str] = []

    def known(name: str) -> bool:
        return name in CTES or name in FIXTURES

    def body_of(name: str) -> str:
        return CTES.get(name) or FIXTURES[name]

    def visit(text: str) -> None:
        found = re.findall(r"@([a-z]\w*)", text) + [t for t in re.findall(r"\{([a-z]\w*)\}", text) if t not in TABLES]
        for name in found:
            if known(name) and name not in names:
                visit(body_of(name))
                if name not in names:
                    names.append(name)

    def plain(text: str) -> str:
        bare = re.sub(r"\{([a-z]\w*)\}", r"\1", text)
        return re.sub(r"@([a-z]\w*)", lambda m: m[1] if known(m[1]) else m[0], bare)

    visit(sql)
    ctes = [f"{n} AS ({plain(body_of(n))})" for n in names]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


# Shared steps of the checking statements.
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def rnd(expr: str, digits: int = 2) -> str:
    """Half-up rounding of the shortest decimal form, as Spark rounds doubles."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def any_like(expr: str, words) -> str:
    """True when the text holds one of the words."""
    return "(" + " OR ".join(f"contains({expr}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def mapping(expr: str, table: dict, default: str = "NULL") -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"
