"""Registered queries of this package and their SQL equivalents.

Every query runs its operator with production parameters over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES`` (name -> function) and ``ORACLE_SQL`` (name -> DuckDB SQL).
MODULES = (
    "query_decontaminate",
    "query_extract",
    "query_neardup",
    "query_substring",
    "query_quality",
    "query_toxicity",
    "query_mixing",
    "query_media",
    "query_licenses",
    "query_warc",
)


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"marlstone.llm.{name}"), attribute)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
