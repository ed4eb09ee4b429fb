"""All registered queries and their SQL counterparts, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from burncal.plans import clusters, detections, feeds, learning, rules, selections, series, streams

MODULES = (detections, series, clusters, selections, learning, streams, feeds, rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
