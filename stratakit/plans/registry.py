"""Registered queries (Spark) and their DuckDB oracle SQL.

Each key is one operator of the inventory.  ``QUERIES[key](spark, sf_dir)``
returns a DataFrame; ``ORACLE[key]`` is the equivalent SQL over the driver's
pre-registered tables.  Column names and types are aligned on both sides.
Modules that add queries import ``register`` from here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import q_clean, q_describe  # noqa: F401
    for mod in ("q_audit", "q_sampling", "q_evaluate", "q_explain", "q_learn", "q_tables"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{mod}":
                raise
