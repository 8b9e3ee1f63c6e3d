"""Operators whose result depends on order: as-of joins, runs, sessions, fills, interval merges.

All are window functions over one partitioning by the keys, so a chain of them on the same keys
shuffles once. ``order`` must be a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def asof_join(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_time: str, right_time: str, take: Sequence[str], right_order: Sequence[str] = ()) -> DataFrame:
    """Left rows with, as columns named in take, the last right row at or before their time; NULL where there is none.

    One union and one window in place of a range join: the cost is a sort by (keys, time), however far back the match lies.
    """
    packed = F.struct(*(F.col(c) for c in take)).alias("__hit")
    names = left.columns
    a = left.select(*(F.col(k) for k in keys), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"__o{i}") for i, c in enumerate(right_order)), F.struct(*names).alias("__row"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("__hit"))
    b = right.select(*(F.col(k) for k in keys), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(right_order)), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__row"), packed)
    w = _over(keys, ["__t", "__side", *(f"__o{i}" for i in range(len(right_order)))]).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__hit", F.last("__hit", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *(F.col(f"__hit.{c}").alias(c) for c in take))


def overlap_join(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs with the same keys whose spans overlap (both comparisons strict). Spans are cut into buckets of ``width``, joined by equality, and each pair is kept in the one bucket where the later of both starts."""
    bucket = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    a = left.withColumn("__b", bucket(*left_span))
    b = right.withColumn("__b", bucket(*right_span))
    (ls, le), (rs, re_) = left_span, right_span
    both = a.join(b, [*keys, "__b"]).where((F.col(rs) < F.col(le)) & (F.col(re_) > F.col(ls)) & (F.col("__b") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width)))
    return both.drop("__b")


def run_ids(df: DataFrame, inside: Column, *, keys: Sequence[str], order: Sequence, name: str = "run_id") -> DataFrame:
    """Numbers the runs of consecutive rows inside, from 1; 0 outside."""
    w = _over(keys, order)
    x = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    x = x.withColumn("__new", (F.col("__in") & ~F.coalesce(F.lag("__in").over(w), F.lit(False))).cast("int"))
    total = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(name, F.when(F.col("__in"), total).otherwise(0)).drop("__in", "__new")


def change_ids(df: DataFrame, changed: Column, *, keys: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """Numbers stretches from 0; a row where ``changed`` holds begins one (the first row always does, as 0)."""
    w = _over(keys, order)
    x = df.withColumn("__c", F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(changed.cast("int"), F.lit(0))))
    return x.withColumn(name, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def collapse_runs(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, mean: str) -> DataFrame:
    """Runs of one value become a row each: keys, run (from 0), value, mean of ``mean``, n."""
    w = _over(keys, order)
    x = change_ids(df, ~F.col(value).eqNullSafe(F.lag(value).over(w)), keys=keys, order=order, name="run")
    return x.groupBy(*keys, "run", value).agg(F.avg(mean).alias("mean"), F.count("*").alias("n"))


def sessions_by_reset(df: DataFrame, time: str, *, keys: Sequence[str], order: Sequence, drop: float, name: str = "session_id") -> DataFrame:
    """A new session begins where time falls by more than ``drop`` against the row before."""
    return change_ids(df, F.lag(time).over(_over(keys, order)) - F.col(time) > drop, keys=keys, order=order, name=name)


def bounded_fill(df: DataFrame, value: str, reach: str, *, keys: Sequence[str], order: Sequence, name: str, default: float = 0.0) -> DataFrame:
    """Carries value over the ceil(reach) - 1 rows that follow it, up to the next value."""
    w = _over(keys, order)
    x = df.withColumn("__i", F.row_number().over(w))
    hit = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).alias("v"), F.ceil(reach).alias("n")))
    x = x.withColumn("__h", F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn(name, F.when(F.col("__i") - F.col("__h.i") < F.greatest(F.col("__h.n"), F.lit(1)), F.col("__h.v")).otherwise(F.lit(default))).drop("__i", "__h")


def merge_by_gap(df: DataFrame, start: str, end: str, *, keys: Sequence[str], gap: float) -> DataFrame:
    """Joins spans whose distance to what came before is at most gap: keys, start, end, n. An unknown start or end comes last."""
    order = [F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last()]
    reach = F.max(end).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    x = change_ids(df, F.col(start) - reach > gap, keys=keys, order=order, name="__g")
    return x.groupBy(*keys, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__g")


def hysteresis(df: DataFrame, level: str, *, on: float | Column, off: float | Column, keys: Sequence[str], order: Sequence, name: str = "active") -> DataFrame:
    """1 from where level reaches ``on`` until it falls below ``off``."""
    mark = F.when(F.col(level) >= on, 1).when(F.col(level) < off, 0)
    return df.withColumn(name, F.coalesce(F.last(mark, ignorenulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def enforce_min_run(df: DataFrame, flag: str, least: int, *, keys: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """Runs of 1 shorter than ``least`` rows become 0."""
    x = run_ids(df, F.col(flag) == 1, keys=keys, order=order, name="__r")
    n = F.count("*").over(Window.partitionBy(*keys, "__r"))
    return x.withColumn(name, F.when((F.col("__r") > 0) & (n >= least), 1).otherwise(0)).drop("__r")


def interpolate(df: DataFrame, x: str, y: str, *, keys: Sequence[str], name: str) -> DataFrame:
    """Fills NULL y linearly between neighbours in x, flat beyond the ends."""
    w = _over(keys, [x])
    known = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumn("__a", a).withColumn("__b", b)
    line = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * (F.col(x) - F.col("__a.x")) / F.nullif(F.col("__b.x") - F.col("__a.x"), F.lit(0))
    return d.withColumn(name, F.coalesce(F.col(y), line, F.col("__a.y"), F.col("__b.y"))).drop("__a", "__b")


def first_rows(df: DataFrame, k: int, *, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(_over(keys, order))).where(F.col("rank") <= k)


def word_windows(df: DataFrame, words: str, *, size: int, step: int, tail: bool, name: str = "window_words", start: str = "window_start") -> DataFrame:
    """Sliding windows over an array of words, by start; with tail also the last ``size`` words; a short array is one window."""
    n = F.size(words)
    regular = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(step))
    starts = F.when(n == 0, F.expr("cast(array() as array<int>)")).otherwise(F.array_distinct(F.concat(regular, F.array(F.greatest(n - size, F.lit(0))))) if tail else regular)
    return df.withColumn(start, F.explode(starts)).withColumn(name, F.slice(F.col(words), F.col(start) + 1, size))


def gaussian(df: DataFrame, value: str, *, sigma: float, radius: int, keys: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """Weighted mean over 2 * radius + 1 rows with the edge repeated (a truncated Gaussian kernel, boundary "nearest")."""
    from math import exp

    weights = [exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    w = _over(keys, order)
    ends = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumn("__f", F.first(value).over(ends)).withColumn("__l", F.last(value).over(ends))
    terms = []
    for k, x in zip(range(-radius, radius + 1), weights, strict=True):
        moved = F.col(value) if k == 0 else F.coalesce(F.lag(value, -k).over(w), F.col("__f")) if k < 0 else F.coalesce(F.lead(value, k).over(w), F.col("__l"))
        terms.append(moved * (x / sum(weights)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return d.withColumn(name, total).drop("__f", "__l")
