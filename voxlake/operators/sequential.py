"""Operators whose every step depends on the one before: folds over a call's rows, and decoding by chunks.

A call's rows are bounded by its length, so an array of them fits a task. Long sequences are decoded chunk by chunk.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxlake.storage import written


def least_loaded(plan: DataFrame, *, key: str, size: str, bins: int) -> DataFrame:
    """Largest first, each to the bin with the least load (the first of equals). The plan is a list of campaigns; it is one group by nature."""

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([size, key], ascending=[False, True])
        heap = [(0, b) for b in range(bins)]
        out = []
        for n in rows[size]:
            load, b = heapq.heappop(heap)
            out.append(b)
            heapq.heappush(heap, (load + int(n), b))
        return rows.assign(bin=out)

    return plan.groupBy(F.lit("all").alias("all")).applyInPandas(assign, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in plan.schema)}, bin int")


#: Rows of a sequence that are decoded at a time.
CHUNK = 1024


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: the best sums over all ways through a then b."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def through(e: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """A chunk's max-plus matrix: from the label before it to its last label, the best sum of its transitions and emissions. Products are combined pairwise, so its depth is the logarithm of the rows."""
    steps = list(transition[None] + e[:, None, :])
    while len(steps) > 1:
        steps = [times(a, b) for a, b in zip(steps[::2], steps[1::2], strict=False)] + steps[len(steps) & ~1 :]
    return steps[0]


def best_within(e: np.ndarray, transition: np.ndarray, first: np.ndarray, last: int | None = None) -> list[int]:
    """The best labels of some rows, given the scores with which their first row is entered, and their last label if it is known."""
    score, back = first + e[0], np.zeros(e.shape, int)
    for t in range(1, len(e)):
        paths = score[:, None] + transition
        back[t] = paths.argmax(axis=0)
        score = paths.max(axis=0) + e[t]
    best = [int(score.argmax()) if last is None else last]
    for t in range(len(e) - 1, 0, -1):
        best.append(int(back[t, best[-1]]))
    return best[::-1]


def forward(e: np.ndarray, transition: np.ndarray, score: np.ndarray | None, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores after a chunk's last row, and for each row and label the best label before it (of equals the first), given those before its first row (None: it begins a sequence).

    Row by row in the order of the sequence, so that sums round, and equals fall, as in a fold over all rows.
    """
    n = len(start)
    rows, move = e.tolist(), transition.T.tolist()
    labels = range(n)
    back = bytearray() if n <= 256 else []
    now = None if score is None else score.tolist()
    for x in rows:
        if now is None:
            now = [float(start[k]) + x[k] for k in labels]
            back.extend([0] * n)
            continue
        then = []
        for k in labels:
            own = move[k]
            best, at = now[0] + own[0], 0
            for j in range(1, n):
                if (v := now[j] + own[j]) > best:
                    best, at = v, j
            then.append(best + x[k])
            back.append(at)
        now = then
    return np.array(now), np.array(back if n > 256 else np.frombuffer(back, np.uint8)).reshape(-1, n)


def traced(back: np.ndarray, last: int) -> list[int]:
    """The labels of a chunk whose last is known."""
    out, label = [], last
    for row in back[::-1].tolist():
        out.append(label)
        label = row[label]
    return out[::-1]


def viterbi(emissions: DataFrame, *, keys: str, order: str, column: str, labels: list[str], transition: np.ndarray, start: np.ndarray, chunk: int = CHUNK, probabilities: bool = False) -> DataFrame:
    """The best label sequence of each group; column: array of log emissions by label, whose rows must have them all (see decodable).

    A sequence is cut into chunks of rows, which are written once. One task passes a sequence's chunks in their order, and keeps of each only the scores that enter it and
    from which label each of its last labels came; from its end the last labels of all chunks follow; then each chunk is decoded by itself.
    So a task holds a chunk's rows, or some numbers for each chunk of one sequence, and sums are those of a fold over all rows. With probabilities the column holds these, and
    their logarithms are the C library's, as Spark's differ from it in the last bit.
    """
    key_type, order_type = (emissions.schema[c].dataType.simpleString() for c in (keys, order))
    n = len(labels)
    place = F.row_number().over(Window.partitionBy(keys).orderBy(order)) - 1
    rows = emissions.select(F.col(keys).alias("key"), F.col(order).alias("order"), F.col(column).cast("array<double>").alias("e"), F.floor(place / chunk).alias("chunk"))
    chunks = written(rows.groupBy("key", "chunk").agg(F.sort_array(F.collect_list(F.struct("order", "e"))).alias("r")).select("key", "chunk", F.col("r.order").alias("order"), F.flatten("r.e").alias("e")))

    def scores(e: pa.ListScalar) -> np.ndarray:
        x = np.array(e.values)
        return (np.array([math.log(max(p, 1e-12)) for p in x.tolist()]) if probabilities else x).reshape(-1, n)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of whole sequences, in order: of each the scores before it, None for the first, and its last label."""
        none = object()
        key, enters, origins, final = none, [], [], None

        def told() -> pa.RecordBatch:
            last = [int(final.argmax())]
            for origin in origins[:0:-1]:
                last.append(origin[last[-1]])
            return pa.RecordBatch.from_arrays([pa.array([key] * len(enters), key_arrow), pa.array(range(len(enters)), pa.int64()), pa.array(enters, pa.list_(pa.float64())), pa.array(last[::-1], pa.int32())], names=["key", "chunk", "before", "last"])

        for batch in batches:
            for own, e in zip(batch.column("key").to_pylist(), batch.column("e"), strict=True):
                if own != key or key is none:
                    if key is not none:
                        yield told()
                    key, enters, origins, final = own, [], [], None
                enters.append(None if final is None else final.tolist())
                final, back = forward(scores(e), transition, final, start)
                origin = list(range(n))
                for row in back[::-1].tolist():
                    origin = [row[k] for k in origin]
                origins.append(origin)
        if key is not none:
            yield told()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("e", "before", "last")]
            places, found = [], []
            for row, (e, before, last) in enumerate(zip(columns[0], columns[1].to_pylist(), columns[2].to_pylist(), strict=True)):
                _, back = forward(scores(e), transition, None if before is None else np.array(before), start)
                best = traced(back, last)
                places += [row] * len(best)
                found += best
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(places, pa.int64())), batch.column("order").flatten(), pa.array(labels, pa.string()).take(pa.array(found, pa.int64()))], names=[keys, order, "label"])

    key_arrow = to_arrow_type(emissions.schema[keys].dataType)
    whole = chunks.select("key", "chunk", "e").repartition("key").sortWithinPartitions("key", "chunk")
    ends = whole.mapInArrow(passed, f"key {key_type}, chunk long, before array<double>, last int")
    return chunks.join(ends, ["key", "chunk"]).select("key", "order", "e", "before", "last").mapInArrow(decode, f"{keys} {key_type}, {order} {order_type}, label string")


def decodable(emissions: DataFrame, *, keys: str, order: str, column: str, labels: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that can be decoded, and a quarantine of the others: the key, rows, bad rows, and why the first of them is bad."""
    e = F.col(column)
    why = F.when(F.col(order).isNull(), "no place").when(e.isNull(), "no emissions").when(F.size(e) != labels, "labels missing").when(F.exists(e, lambda x: x.isNull() | F.isnan(x)), "an emission is no number")
    bad = emissions.withColumn("__why", why).where("__why is not null").groupBy(keys).agg(F.count("*").alias("bad"), F.min_by("__why", F.struct(F.coalesce(F.col(order).cast("string"), F.lit("")), "__why")).alias("reason"))
    quarantine = emissions.groupBy(keys).agg(F.count("*").alias("rows")).join(bad, keys)
    return emissions.join(bad.select(keys), keys, "left_anti"), quarantine


def smoothed(df: DataFrame, label: str, *, keys: str, order: list, reach: int) -> DataFrame:
    """The rows with column smooth: the majority within +-reach; of equals the one seen first in the window. Null labels don't count."""
    seen = F.collect_list(label).over(Window.partitionBy(keys).orderBy(*order).rowsBetween(-reach, reach))
    votes = F.transform(F.array_distinct("__w"), lambda v, k: F.struct(F.size(F.filter("__w", lambda x: x == v)).alias("n"), (-k).alias("place"), v.alias("v")))
    return df.withColumn("__w", seen).withColumn("smooth", F.array_max(votes)["v"]).drop("__w")


def _pass(sizes: Column, least: int, most: int) -> Column:
    """One pass over an array of sizes, as a fold: units (the number of each item's unit) and totals (the size of each unit).

    An item under ``least`` joins the unit before it or the item after it, whichever gives the smaller sum (of equals the one before), if that is at most
    ``most``; an item that the one before it has joined is passed over.
    """
    empty = F.expr("cast(array() as array<int>)")
    begin = F.struct(empty.alias("units"), empty.alias("totals"), F.lit(None).cast("int").alias("open"), F.lit(False).alias("taken"))

    def step(state: Column, i: Column) -> Column:
        size, following = F.element_at(sizes, i + 1), F.try_element_at(sizes, i + 2)
        units, totals, open_ = state["units"], state["totals"], state["open"]
        back, ahead = F.when(open_ + size <= most, open_ + size), F.when(size + following <= most, size + following)
        joins_back = (size < least) & back.isNotNull() & (ahead.isNull() | (back <= ahead))
        takes_next = (size < least) & ~joins_back & ahead.isNotNull()
        closed = F.when(open_.isNull(), totals).otherwise(F.concat(totals, F.array(open_)))
        now = F.size(units)
        new = F.when(now == 0, F.lit(0)).otherwise(F.try_element_at(units, F.lit(-1)) + 1)

        def after(units: Column, totals: Column, open_: Column, taken: Column) -> Column:
            return F.struct(units.alias("units"), totals.alias("totals"), open_.cast("int").alias("open"), taken.alias("taken"))

        same = F.try_element_at(units, F.lit(-1))
        return (
            F.when(state["taken"], after(F.concat(units, F.array(same)), totals, open_, F.lit(False)))
            .when(F.coalesce(joins_back, F.lit(False)), after(F.concat(units, F.array(same)), totals, back, F.lit(False)))
            .when(F.coalesce(takes_next, F.lit(False)), after(F.concat(units, F.array(new)), closed, ahead, F.lit(True)))
            .otherwise(after(F.concat(units, F.array(new)), closed, size, F.lit(False)))
        )

    finish = lambda state: F.struct(state["units"].alias("units"), F.when(state["open"].isNull(), state["totals"]).otherwise(F.concat(state["totals"], F.array(state["open"]))).alias("totals"))
    places = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.size(sizes) - 1)).otherwise(empty)
    return F.aggregate(places, begin, step, finish)


def compacted(df: DataFrame, words: str, *, keys: str, order: str, least: int, most: int) -> DataFrame:
    """The rows of 1 to ``most`` words with column unit: short rows join a neighbour in one pass over the call, and what is still short in another. Folds of built-ins over each call's rows in order; a call's rows are one array."""
    rows = df.where((F.col(words) > 0) & (F.col(words) <= most))
    calls = rows.groupBy(keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*df.columns).alias("__row"), F.col(words).cast("int").alias("__n")))).alias("__r"))
    once = calls.withColumn("__one", _pass(F.col("__r.__n"), least, most))
    twice = once.withColumn("__two", _pass(F.col("__one.totals"), least, most))
    unit = F.transform("__r", lambda r, i: F.struct(r["__row"].alias("row"), F.element_at(F.col("__two.units"), F.element_at(F.col("__one.units"), i + 1) + 1).alias("unit")))
    return twice.select(F.explode(unit).alias("x")).select("x.row.*", "x.unit")


def merged_short(df: DataFrame, *, keys: str, start: str, end: str, speaker: str, words: str, least: int, gap: float, order: list | None = None) -> DataFrame:
    """The rows with column unit: a row under ``least`` words joins the row before it if that has its speaker and ends within gap, else the one after on the same terms.

    Joins are between neighbours, so units are the stretches between the places where neither of two neighbours joins the other.
    """
    w = Window.partitionBy(keys).orderBy(*(order or [start, end]))
    short = F.coalesce(F.col(words) < least, F.lit(False))
    close = F.coalesce((F.lag(speaker).over(w) == F.col(speaker)) & (F.col(start) - F.lag(end).over(w) <= gap), F.lit(False))
    x = df.withColumn("__close", close).withColumn("__back", short & F.col("__close"))
    ahead = F.coalesce(F.lead("__close").over(w), F.lit(False))
    x = x.withColumn("__fore", short & ~F.col("__back") & ahead)
    x = x.withColumn("__new", (~(F.col("__back") | F.coalesce(F.lag("__fore").over(w), F.lit(False)))).cast("int"))
    unit = (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")
    return x.withColumn("unit", unit).drop("__close", "__back", "__fore", "__new")


def log_emissions(*columns: Column) -> Column:
    return F.array(*(F.ln(F.greatest(c, F.lit(1e-12))) for c in columns))
