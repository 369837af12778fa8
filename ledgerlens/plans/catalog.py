"""Registry of named queries over the shared tables.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the
equivalent DuckDB SQL (or ``None`` where the operator is not expressible in
SQL).  Column names and types are aligned on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # importing the modules fills the registry
    from . import (q_augment, q_encode, q_io, q_learn, q_model, q_store, q_summary,  # noqa: F401
                   q_text)
    return dict(_REGISTRY)
