"""Every registered query with its oracle: name -> (callable, SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


#: Modules that register queries when imported.
_MODULES = ("trajectory_queries", "relational_queries", "training_queries", "text_queries", "system_queries", "more_queries", "grading_queries", "decoding_queries", "wider_queries")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tracemill.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
