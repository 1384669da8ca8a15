"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pluvian.llm import oracles, queries as q

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and name[2].isdigit()}


def all_oracles() -> dict[str, str]:
    return dict(oracles.ORACLES)
