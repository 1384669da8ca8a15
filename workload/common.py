"""Shared bits of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating results at six places with one sign of zero, so two engines can be compared by hash."""
    return df.select([(F.round(F.col(n), places) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n)
                      for n, t in df.dtypes])


class Registry:
    """Name -> (Spark query, oracle SQL or None)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
            if oracle is not None:
                self.oracles[name] = oracle
            return fn
        return register


def r(expr: str, alias: str) -> str:
    """Oracle side of `rounded`."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {alias}"
