"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, joins, learning, ordered, registry, scalars, scoring

FLAGSHIP = "A07_campaign_quality"
MODULES = (aggregates, joins, ordered, scalars, scoring, learning)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
