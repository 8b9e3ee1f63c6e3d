"""Event streams: windows with watermarks, sessions, deduplication, stateful runs, and merges of each batch.

Every function takes a streaming or a batch frame; on the same rows both give the same result, but for ``once``, which says how it differs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxlake.operators import merge
from voxlake.storage import shared_folder

LATE = "10 minutes"


def read(spark: SparkSession, folder: str, name: str, *, files_per_batch: int = 100) -> DataFrame:
    """A folder's Parquet files of one name, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
    zoneless = [f.name for f in schema if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})  # watermarks need an instant


def tumbling(events: DataFrame, every: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", LATE).groupBy(F.window("ts", every).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", every: str = "15 minutes") -> DataFrame:
    g = events.withWatermark("ts", LATE).groupBy(F.window("ts", length, every).alias("w"))
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def once(events: DataFrame) -> DataFrame:
    """One row per event id; a stream tells duplicates apart only within its watermark, so there a copy that is later than that is a row of its own, as it is not in the batch form."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def _count_types(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for part in rows:
        n, total = n + len(part), total + float(part["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame) -> DataFrame:
    """Each user's count and sum so far, kept in state; a row per user and batch."""
    return events.groupBy("user_id").applyInPandasWithState(_count_types, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def available(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is, with a checkpoint, and gives its output: the last batch's in complete mode, else all batches'.

    A batch is written under its own number, so one that is repeated after a failure replaces itself.
    """
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{path}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("batch"))
        out = out.join(F.broadcast(last), "batch")
    return out.drop("batch")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's finished versions, least first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def merged(stream: DataFrame, keys: list[str], order: list, *, path: str | None = None, buckets: int = 64) -> DataFrame:
    """The latest row of each key after all batches, each merged into the table before it.

    The table lies under path, and so does the stream's checkpoint: a run that is started again goes on from both. Rows lie in folders by a hash of
    their key; a batch makes a new version of only those folders that its keys fall into, numbered by the batch, so one that is repeated after a failure
    replaces itself. The version to read is told from the finished folders, not kept in memory. Before the first batch the table is empty.
    """
    spark, path = stream.sparkSession, path or shared_folder(stream.sparkSession)
    schema = stream.schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def newest(bucket: int, before: int | None = None) -> list[str]:
        found = [n for n in _versions(spark, f"{path}/table/b{bucket}") if before is None or n < before]
        return [f"{path}/table/b{bucket}/v{found[-1]}"] if found else []

    def write(batch: DataFrame, number: int) -> None:
        new = merge.latest(batch, keys=keys, order=order).withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(r["__b"] for r in new.select("__b").distinct().collect())
            old = [p for b in touched for p in newest(b, number)]
            rows = new
            if old:
                was = spark.read.schema(kinds).parquet(*old).withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
                rows = merge.latest(was.unionByName(new), keys=keys, order=order)
            stage = f"{path}/stage/v{number}"
            rows.write.mode("overwrite").partitionBy("__b").parquet(stage)
            jvm = spark._jvm
            fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
            P = jvm.org.apache.hadoop.fs.Path
            for b in touched:
                target = P(f"{path}/table/b{b}/v{number}")
                fs.delete(target, True)
                fs.mkdirs(target.getParent())
                fs.rename(P(f"{stage}/__b={b}"), target)
                fs.create(P(f"{path}/table/b{b}/v{number}/_SUCCESS"), True).close()
        finally:
            new.unpersist()

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = [p for b in range(buckets) for p in newest(b)]
    return spark.read.schema(kinds).parquet(*found) if found else spark.createDataFrame([], schema)
