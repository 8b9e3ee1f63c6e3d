"""Small sides of joins, whose size is looked at before they are sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def bounded(df: DataFrame, rows: int, what: str) -> DataFrame:
    """df with a hint to broadcast it; more than that many rows are refused."""
    if df.limit(rows + 1).count() > rows:
        raise ValueError(f"more than {rows} {what}: they are not sent to every task")
    return F.broadcast(df)


def fetched(df: DataFrame, rows: int, what: str) -> list[Row]:
    """df's rows; more than that many are refused."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} {what}: they are not sent to every task")
    return found
