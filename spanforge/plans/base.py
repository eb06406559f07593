"""Registration of a query beside its SQL twin, and helpers that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.store import scratch  # noqa: F401  queries take it from here

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (table reader) under its own name."""

    def keep(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    """Rounded to six decimals: sums of doubles depend on their order."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
