"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = ("ingest", "delta", "rollup", "series", "report", "payload", "alert", "custom", "stream")


class Family(dict):
    """Queries of one family: name to (query, SQL or None)."""

    def add(self, name: str, sql: str | None = None):
        def keep(query: Query) -> Query:
            if name in self:
                raise ValueError(name)
            self[name] = (query, sql)
            return query

        return keep


@cache
def everything() -> Family:
    merged = Family()
    for family in FAMILIES:
        merged.update(import_module(f"gaugeweave.checks.{family}_queries").FAMILY)
    return merged


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in everything().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in everything().items() if sql is not None}
