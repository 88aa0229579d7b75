"""Registry of named queries: each is a Spark plan over the shared tables plus (when
SQL-expressible) an independent DuckDB oracle string.

Every registered query reads whole tables (or views Spark derives from them); results
are rounded to 6 decimals on double columns for cross-engine comparison.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.exprs import rounded

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return rounded(_fn(spark, sf_dir))
        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its @register decorators run."""
    from tidemark.plans import (q_longitudinal, q_labels, q_metrics, q_features,  # noqa: F401
                                q_reports, q_selection, q_splits, q_quality, q_models, q_validation,
                                q_inventory)
