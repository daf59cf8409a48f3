"""Named queries, each with the SQL that states the same result over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratafold.fixtures import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(views: str, body: str) -> str:
    """``body`` preceded by the named fixture views; a body that opens with WITH keeps its own ones."""
    needed: list[str] = []

    def add(name: str) -> None:
        for parent in VIEWS[name][0].split():
            add(parent)
        if name not in needed:
            needed.append(name)

    for name in views.split():
        add(name)
    head = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in needed)
    body = body.strip()
    if not head:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {head}, {body[5:].removeprefix('RECURSIVE ')}"
    return f"WITH RECURSIVE {head} {body}"


def query(name: str, views: str = "", sql: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` under ``name`` with its SQL."""

    def keep(build):
        assert name not in QUERIES, name
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return keep
