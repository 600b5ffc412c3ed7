"""Name -> query and name -> DuckDB text, filled by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlwright.plans.duck import build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def oracle_texts() -> dict[str, str]:
    """DuckDB texts with the views they need in front."""
    return {name: build(sql) for name, sql in ORACLES.items()}
