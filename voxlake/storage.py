"""Where intermediate tables go: the cluster's shared checkpoint folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="voxlake-")


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    if (chosen := sc._jsc.sc().getCheckpointDir()).isDefined():  # by setCheckpointDir
        return chosen.get()
    if sc.master.startswith("local"):
        return _own_folder()  # one process, so its folder is everyone's
    raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")


def shared_folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir or the folder of setCheckpointDir; under one of this process where neither is set and there are no executors."""
    return f"{_folder(spark).rstrip('/')}/voxlake-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet files in the shared folder: computed once, safe from lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
