"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named sub-query other SQL texts may use."""
    VIEWS[name] = sql


def expand(sql: str) -> str:
    """Put the views a text uses (and the ones they use) in front of it."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                need_first = VIEWS[name]
                used.append(name)
                need(need_first)

    need(sql)
    order = [n for n in VIEWS if n in used]
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + sql


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL it must agree with."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return add
