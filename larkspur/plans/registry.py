"""Every registered query of the library, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import base

MODULES = ("flagship", "text", "links", "values", "predicates", "scoring", "relational", "sources", "classify", "grounding", "streams")


def load() -> None:
    for name in MODULES:
        import_module(f"larkspur.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(base.SQL)
