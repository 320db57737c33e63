"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaylens.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def with_fixtures(body: str) -> str:
    """Put the definitions of all fixtures a text mentions in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in fixtures.SQL and name not in needed:
                visit(fixtures.SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    definitions = ",\n".join(f"{n} AS (\n{fixtures.SQL[n].strip()}\n)" for n in needed)
    own = body.strip()
    if own.upper().startswith("WITH "):
        return f"WITH {definitions},\n{own[5:]}"
    return f"WITH {definitions}\n{own}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL where SQL can express it."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_fixtures(sql)
        return function

    return add
