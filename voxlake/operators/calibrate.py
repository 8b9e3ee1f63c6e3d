"""Thresholds that select a given share of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024
#: A little over 2**-53: v + STEP * v is the next double above v, v - STEP * v the next below, for normal v.
STEP = 1.1113071e-16
TINY = 4.9e-324


def counts_below(df: DataFrame, value: str, *more: str) -> DataFrame:
    """value, n, the sums of the columns more, below (rows under it) and upto (rows at or under it): counts first, so only distinct values are ordered.

    The running sum is taken within at most RANGES equal ranges of values and offset by the ranges' totals, so no task holds all values.
    """
    n = df.groupBy(value).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in more))
    ends = n.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.least(F.floor(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * RANGES), F.lit(RANGES - 1))
    ranges = n.crossJoin(F.broadcast(ends)).withColumn("__r", F.coalesce(place, F.lit(0))).drop("__lo", "__hi")
    totals = ranges.groupBy("__r").agg(F.sum("n").alias("__t"))  # at most RANGES rows
    before = totals.withColumn("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__r", "__b")
    own = F.sum("n").over(Window.partitionBy("__r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("__o") + F.col("__b")
    return ranges.withColumn("__o", own).join(F.broadcast(before), "__r").select(value, "n", *more, (upto - F.col("n")).alias("below"), upto.alias("upto"))


def percentile(df: DataFrame, value: str, share: float, name: str = "p") -> DataFrame:
    """One row: the exact percentile of a column, linear between neighbours, from the running counts of its distinct values. Nulls and NaN don't count; none of them: null."""
    rows = df.select(F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    counts = counts_below(rows, "__v")
    place = (F.col("__n") - 1) * F.lit(share)
    x = counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__n")))).withColumn("__at", place)
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("__v")))
    low, high = at(F.floor("__at")), at(F.ceil("__at"))
    return x.agg(low.alias("__l"), high.alias("__h"), F.first(F.col("__at") - F.floor("__at")).alias("__s")).select((F.col("__l") + (F.col("__h") - F.col("__l")) * F.col("__s")).alias(name))


def above(v: Column) -> Column:
    """The next double from v towards 1."""
    return F.when(v == 0, F.lit(TINY)).when(v < 1, v + v * STEP).when(v > 1, v - v * STEP).otherwise(v)


def thresholds(calls: DataFrame, *, empty: str, price: str, mac: str, share: float) -> DataFrame:
    """One row: price_th, mac_th, general_th, selected, wanted, so that ``empty or price < price_th or mac < mac_th`` selects ceil(n * share) calls.

    Candidates are (v, v), (v+, v), (v, v+) and (v+, v+) for every value v that is the lesser likelihood of a call that is not
    empty, v+ being the next double. The first exact one of different thresholds is taken; else the last exact one of equal thresholds, which is
    general_th too, with one threshold moved by a step; else the first of those closest to the count. If nothing is wanted, or the empty calls do, the
    thresholds are 0 and the next double. Missing likelihoods select nothing.

    The counts of all candidates follow from a running sum over distinct values: of the calls whose lesser likelihood is v, (v+, v) takes those whose price is v,
    (v, v+) those whose mac is v, (v+, v+) all.
    """
    known = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).otherwise(float("inf"))
    is_empty = F.coalesce(F.col(empty), F.lit(0)) == 1
    rows = calls.select(is_empty.alias("e"), known(price).alias("p"), known(mac).alias("m"))
    size = rows.agg(F.ceil(F.count("*") * F.lit(share)).cast("long").alias("wanted"), F.count_if("e").alias("empties"))
    v = F.least("p", "m")
    lesser = rows.where(~F.col("e")).select(v.alias("v"), (F.col("p") == v).cast("long").alias("np"), (F.col("m") == v).cast("long").alias("nm")).where("v < double('infinity')")
    up, low, taken = above(F.col("v")), F.col("v"), F.when(F.col("v") < 1, F.lit(1)).otherwise(0)
    each = F.array(*(F.struct(F.lit(k).alias("k"), p.alias("p"), m.alias("m"), (F.col("empties") + F.col("below") + taken * n).alias("total")) for k, (p, m, n) in enumerate(((low, low, F.lit(0)), (up, low, F.col("np")), (low, up, F.col("nm")), (up, up, F.col("n"))))))
    found = counts_below(lesser, "v", "np", "nm").crossJoin(F.broadcast(size)).select("wanted", "v", F.explode(each).alias("c")).select("wanted", "v", "c.*")
    exact, pair, place = F.col("total") == F.col("wanted"), F.struct("p", "m"), F.struct("v", "k")
    best = found.agg(
        F.min_by(pair, F.when(exact & (F.col("p") != F.col("m")), place)).alias("apart"),
        F.max_by(pair, F.when(exact & (F.col("p") == F.col("m")), place)).alias("equal"),
        F.min_by(pair, F.struct(F.abs(F.col("total") - F.col("wanted")), "v", "k")).alias("close"),
    )
    x = size.crossJoin(F.broadcast(best))
    # equal thresholds are moved apart by a step
    moved = lambda c: F.struct(F.when(c.p == c.m, F.when(c.p < 1, c.p).otherwise(c.p - c.p * STEP)).otherwise(c.p).alias("p"), F.when(c.p == c.m, F.when(c.p < 1, above(c.m)).otherwise(c.m)).otherwise(c.m).alias("m"))
    closest = lambda c: F.struct(c.p.alias("p"), F.when(c.p == c.m, F.when(c.m < 1, above(c.m)).otherwise(c.m - c.m * STEP)).otherwise(c.m).alias("m"))
    least = F.struct(F.lit(0.0).alias("p"), F.lit(TINY).alias("m"))
    enough = (F.col("empties") >= F.col("wanted")) | F.col("close").isNull()
    picked = F.when(enough, least).otherwise(F.coalesce(F.col("apart"), F.when(F.col("equal").isNotNull(), moved(F.col("equal"))), closest(F.col("close"))))
    general = F.when(~enough & F.col("apart").isNull(), F.col("equal.p"))
    chosen = x.select("wanted", picked.alias("t"), general.alias("general_th")).select(F.col("t.p").alias("price_th"), F.col("t.m").alias("mac_th"), "general_th", "wanted")
    hits = rows.crossJoin(F.broadcast(chosen)).agg(F.count_if(F.col("e") | (F.col("p") < F.col("price_th")) | (F.col("m") < F.col("mac_th"))).alias("selected"))
    return chosen.crossJoin(F.broadcast(hits)).select("price_th", "mac_th", "general_th", "selected", "wanted")
