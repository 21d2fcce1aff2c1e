"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tractum.catalog.views import VIEW_ORDER, VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the views it names (and the views those name)."""
    wanted = set(names.split())
    for name in reversed(VIEW_ORDER):
        if name in wanted:
            wanted |= set(VIEW_SQL[name][0].split())
    ctes = [f"{n} AS ({VIEW_SQL[n][1]})" for n in VIEW_ORDER if n in wanted]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH "):]
    return "WITH " + ", ".join(ctes) + " " + body


def query(key: str, views: str = "", sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(views, sql)
        return fn

    return register
