"""Names, queries and SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn
    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def text(c: str) -> Column:
    """A nullable number as text, so that both sides of a check show it alike."""
    return F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c)
