"""Registry of named queries: a Spark builder and (where SQL can say it) the DuckDB oracle.

Each registered query reads the driver tables of one scale-factor directory
(or tables Spark derives from them) and returns a flat DataFrame whose column
names equal the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: Callable[[], str] | None
    ids: str                      # inventory ids covered (SURVEY §2)
    headline: bool = False        # part of bench.py


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, ids: str, sql: Callable[[], str] | None = None, headline: bool = False):
    def deco(fn):
        REGISTRY[name] = QuerySpec(name, fn, sql, ids, headline)
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    from . import queries  # noqa: F401  (registers on import)
    return REGISTRY
