"""Registry of the core queries: Spark callable and SQL twin side by side."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("social", "pairs", "cycles", "scoring", "calibration", "statistics", "text", "sampling", "sources", "streams")


def _modules():
    return [import_module(f"tallyloom.queries.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.REGISTRY.sql.items()}
