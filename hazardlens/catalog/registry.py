"""Registration of queries and of the SQL each is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardlens.catalog.check_sql import with_tables
from hazardlens.catalog.tables import Tables
from hazardlens.session import pin_utc

Build = Callable[[Tables], DataFrame]

_MODULES = ("edges", "columns", "combining", "reports", "jobs", "profiling", "models", "arrivals")
_BUILDS: dict[str, Build] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a job under a name; ``sql`` may use the names of the derived tables."""
    def register(build: Build) -> Build:
        if name in _BUILDS:
            raise ValueError(f"two queries named {name}")
        _BUILDS[name] = build
        if sql:
            _SQL[name] = with_tables(sql)
        return build
    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"hazardlens.catalog.{module}")


def _runner(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(pin_utc(spark), sf_dir))
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(build) for name, build in _BUILDS.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
