"""Registered queries over the benchmark tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("recommend", "matching", "review", "graph", "quality", "catalog", "scalar", "ingest", "control")
Query = Callable[[SparkSession, str], DataFrame]


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"marlstone.queries.{name}"), attribute)
    return out


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
