"""Every registered query and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import details, documents, graph, lifecycle, normalize, packages, point_in_time, reconcile, research, search, sources, timeseries

PARTS = [timeseries, search, normalize, point_in_time, reconcile, research, sources, packages, graph, documents, details, lifecycle]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
