"""Every operator as a query over the given tables, with its check in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowloom.plans.adapter_sql import with_views
from flowloom.plans.adapters import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None


_REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register the decorated ``Tables -> DataFrame`` function under ``name``.

    ``views=False`` is for SQL that already defines the adapter views it uses.
    """
    def register(fn: Callable[[Tables], DataFrame]):
        if name in _REGISTRY:
            raise ValueError(f"query {name} registered twice")
        _REGISTRY[name] = Query(name, fn, with_views(sql) if sql and views else sql)
        return fn

    return register


def load() -> dict[str, Query]:
    from flowloom.plans.catalog import (  # noqa: F401
        aggregates, captures, detection, flowbuild, joins, learning, live, scalars)

    return dict(_REGISTRY)


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, sf_dir: q.build(Tables(spark, sf_dir))

    return {name: bind(q) for name, q in load().items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in load().items() if q.sql}
