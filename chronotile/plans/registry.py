"""Named queries and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "reduce_samples"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, folder) under a name."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


from . import samples, maps, catalogs, models  # noqa: E402, F401, I001  (they register their queries)
