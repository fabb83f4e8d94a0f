"""Registry of named queries with their oracle text."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegrid.plans.shipping import ship
from pagegrid.plans.tables import Tables, oracle_text

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

_MODULES = ["scalars", "rows", "pages", "links", "events", "control", "monitor", "lists", "streams"]


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle_text(oracle)
        return fn

    return register


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"pagegrid.queries.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {n: (lambda spark, sf_dir, fn=f: fn(Tables(ship(spark), sf_dir))) for n, f in sorted(_QUERIES.items())}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(sorted(_ORACLES.items()))
