"""Registry of queries: a Spark callable and, where it can be said in SQL, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loometric.queries.views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Register a query. ``views`` are stand-in views that its SQL check reads."""
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = _with_views(sql, views, recursive)
        return function

    return add


def _with_views(sql: str, views: tuple[str, ...], recursive: bool) -> str:
    ordered: list[str] = []

    def need(name: str) -> None:
        inputs, _ = SQL_VIEWS[name]
        for other in inputs:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        need(name)
    parts = [f"{name} AS ({SQL_VIEWS[name][1].strip()})" for name in ordered]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:])
        body = ",\n".join(parts)
    elif parts:
        body = ",\n".join(parts) + "\n" + body
    else:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}"
