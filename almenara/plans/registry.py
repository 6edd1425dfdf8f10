"""Named queries and the DuckDB text each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from almenara.sources.fixtures import Tables, duck_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(
    name: str, reads: tuple[str, ...] = (), oracle: str | None = None
) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register ``fn(tables)`` under ``name``; ``oracle`` may use the derived tables in ``reads``.

    An oracle that starts with a comma adds its own named subqueries after those tables.
    """

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = f"{duck_with(reads)}\n{oracle.strip()}"
        return fn

    return wrap
