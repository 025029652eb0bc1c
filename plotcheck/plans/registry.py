"""All registered queries of the site-check operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotcheck.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]
#: Modules that register queries when they are imported.
MODULES = ("spatial_queries", "raster_queries", "evaluation_queries", "rule_queries", "iterative_queries", "log_queries", "model_queries")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register a function of (view), where view(name) gives a table, as the query ``name``, with its SQL."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):  # noqa: ANN202
        assert name not in _QUERIES, name
        _QUERIES[name] = lambda spark, sf_dir: f(lambda table: fixtures.view(spark, sf_dir, table))
        if sql:
            _SQL[name] = fixtures.with_views(sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"plotcheck.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
