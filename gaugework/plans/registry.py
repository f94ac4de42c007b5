"""Named check queries: a Spark callable and, where SQL can say the same, its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            CHECK_SQL[name] = sql
        return run

    return add


def load() -> None:
    """Import every module that registers queries."""
    from gaugework.plans import (  # noqa: F401
        checks_detect,
        checks_feedback,
        checks_model,
        checks_profile,
    )
