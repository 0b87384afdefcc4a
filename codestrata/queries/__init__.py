"""Registered queries over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers fn(views) → DataFrame under `name`; `sql` is the equivalent on the same tables."""

    def register(fn: Callable) -> Callable:
        from .views import Views

        REGISTRY[name] = Query(name, lambda spark, sf_dir: fn(Views(spark, sf_dir)), sql)
        return fn

    return register


def load_all() -> dict[str, Query]:
    from . import code, evidence, graph, paths, search, segments, stemmed, tables, text  # noqa: F401  (registration)

    return REGISTRY
