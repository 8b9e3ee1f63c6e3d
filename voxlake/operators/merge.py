"""Upserts over immutable tables: a new version of the target from the old one and a batch of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, *, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(target: DataFrame, changes: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Changes replace target rows of the same key; other rows of both stay. Keys are unique in each."""
    return target.join(changes, list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def upsert_with_reset(target: DataFrame, changes: DataFrame, *, key: str, watched: str, flag: str) -> DataFrame:
    """Like upsert, but ``flag`` is kept unless ``watched`` changed, and 0 for what is new or changed. Both have key, watched, flag (target) or key, watched (changes)."""
    t = target.select(key, F.col(watched).alias("__old"), F.col(flag).alias("__flag"))
    both = t.join(changes.select(key, F.col(watched).alias("__new")), key, "full_outer")
    return both.select(key, F.coalesce("__new", "__old").alias(watched), F.when(F.col("__new").isNull() | F.col("__new").eqNullSafe(F.col("__old")), F.coalesce("__flag", F.lit(0))).otherwise(0).alias(flag))


def split_new(changes: DataFrame, target: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Changes with is_new: whether target lacks their key."""
    return changes.join(target.select(*keys).distinct().withColumn("__there", F.lit(True)), list(keys), "left").withColumn("is_new", F.col("__there").isNull()).drop("__there")


def with_keys(changes: DataFrame, existing: DataFrame, *, on: Sequence[str], key: str) -> DataFrame:
    """Existing keys where there are; else new ones that follow the largest, in the order of ``on``.

    New keys are numbered within hash slices and offset by the slices' counts, so no task sees all rows.
    """
    slices = 64
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    found = changes.join(existing.select(*on, key), list(on), "left").withColumn("__s", F.pmod(F.hash(*on), F.lit(slices)))
    old, new = found.where(F.col(key).isNotNull()), found.where(F.col(key).isNull())
    counts = new.groupBy("__s").count()
    offset = counts.withColumn("__o", F.sum("count").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))).select("__s", F.coalesce("__o", F.lit(0)).alias("__o"))
    numbered = new.withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy(*on))).join(F.broadcast(offset), "__s").crossJoin(F.broadcast(top))
    made = numbered.withColumn(key, F.col("__top") + F.col("__o") + F.col("__r"))
    return old.drop("__s").unionByName(made.select(*old.drop("__s").columns))
