"""Registered queries over the provided tables, each with a DuckDB oracle.

Every query reads whole tables (or data Spark derives from them); none caps,
samples or subsets rows.  Each entry pairs the Spark plan with an ANSI/DuckDB
SQL string producing the same columns, so results can be compared by row
count, schema and an order-insensitive value hash.  Entries with ``oracle``
None are checked rows-only (model stages, streaming).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, operators: str, oracle: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, oracle, tuple(operators.split()))
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: q.run for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: q.oracle for k, q in REGISTRY.items() if q.oracle}


def _load() -> None:
    # Importing the modules fills REGISTRY.
    from filingflow.plans import (  # noqa: F401
        queries_index, queries_merge, queries_model, queries_retrieval, queries_stream, queries_text,
        queries_votes,
    )
