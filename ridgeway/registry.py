"""The registry of queries: name, DataFrame builder and, where SQL can say it, the SQL that must agree."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("ridgeway.plans.line_queries", "ridgeway.plans.raster_queries", "ridgeway.plans.network_queries", "ridgeway.plans.tool_queries")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register fn(spark, sf_dir) under a name."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(module)


def registered() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
