"""Registry of the capture queries: name -> callable, name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from capture_tables.functions.linalg import rounded
from capture_tables.plans.fixtures import view, with_views

FLAGSHIP = "d20_pose_error_summary"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query written as f(t) -> DataFrame, where t(view) gives a table or a capture
    view; doubles are rounded to six digits in its result and in the oracle's."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(lambda source: view(spark, sf_dir, source)))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return build

    return register


for _module in ("temporal", "relational", "metrics", "columns", "geometry", "masks", "sources", "streams"):
    import_module(f"capture_tables.plans.{_module}_queries")
