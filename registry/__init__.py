"""Registered queries and their oracle SQL, one module per area."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

AREAS = ["plays", "ingest", "resolver", "resolver_rows", "library", "lists", "guard"]


class Area:
    """Collects (name, query, oracle SQL) triples."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.oracle[name] = sql


def _areas() -> list[Area]:
    return [import_module(f"registry.{name}").AREA for name in AREAS]


def all_queries() -> dict[str, Query]:
    return {name: q for area in _areas() for name, q in area.queries.items()}


def all_oracle_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.oracle.items()}
