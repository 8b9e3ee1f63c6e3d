"""Readers and writers of flat tables: delimited text with unknown delimiter, JDBC, append-only and chunked sinks."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.storage import written


def sniff(head: str) -> str:
    """The delimiter that parts a header line most often."""
    return max((",", ";", "\t", "|"), key=head.count)


def read_delimited(spark: SparkSession, path: str, *, encoding: str = "UTF-8") -> DataFrame:
    """A CSV or TSV with a header; all columns are strings. The delimiter is told from the first line, which alone is fetched."""
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    head = first[0].value.lstrip("﻿") if first else ""
    df = spark.read.option("encoding", encoding).option("header", True).option("sep", sniff(head)).csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_decoded(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that are UTF-8, or else of an 8-bit encoding."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "windows-1252"))
    return raw.select("path", F.explode(F.split(F.regexp_replace(text, "^\ufeff", ""), "\r?\n")).alias("line"))


def script_columns(df: DataFrame) -> dict[str, str | None]:
    """Which column of a grading script is the cluster, and which the phrases: by name, else the longest text on average."""
    by = {c.lower().strip(): c for c in df.columns}
    cluster = next((by[n] for n in ("cluster", "topic", "subtag") if n in by), None)
    phrase = next((by[n] for n in ("name", "keyword", "phrase") if n in by), None)
    rest = [c for c in df.columns if c != cluster]
    if phrase is None and rest:
        means = df.agg(*(F.avg(F.length(F.col(f"`{c}`").cast("string"))).alias(str(k)) for k, c in enumerate(rest))).first()
        phrase = max(range(len(rest)), key=lambda k: (means[k] or 0.0, -k))
        phrase = rest[phrase]
    return {"cluster": cluster, "phrase": phrase}


def read_jdbc(spark: SparkSession, url: str, table: str, *, predicates: list[str] | None = None, **options: str) -> DataFrame:
    """A database table; predicates cut it into partitions that are read side by side."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=options) if predicates else spark.read.jdbc(url, table, properties=options)


#: What columns of a database file may be, and rows of one such file.
KINDS, FILE_ROWS = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}, 100_000


def write_files(df: DataFrame, table: str, *, batch: int = 500, rows: int = FILE_ROWS) -> DataFrame:
    """Rows into a database of SQLite files, for sessions whose executors can't reach one database: each task inserts in batches, ``rows`` at most to a file. The files are
    rows of a table in the shared folder, so Spark commits them, and a task that runs twice leaves one. A NaN, which such a file can't hold, is an error."""
    names = [f.name for f in df.schema]
    columns = ", ".join(f'"{f.name}" {KINDS[f.dataType.simpleString()]}' for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, held = None, 0

        def closed() -> pa.RecordBatch:
            data = con.serialize()
            con.close()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

        for whole in batches:
            for lo in range(0, len(whole), batch):
                part = whole.slice(lo, batch)
                values = [c.to_pylist() for c in part.columns]
                if any(isinstance(x, float) and x != x for c in values for x in c):
                    raise ValueError("a NaN can't be held by the database")
                if con is not None and held + len(part) > rows:
                    yield closed()
                    con, held = None, 0
                if con is None:
                    con = sqlite3.connect(":memory:")
                    con.execute(f'CREATE TABLE "{table}" ({columns})')
                with con:  # a batch is a transaction
                    con.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', zip(*values, strict=True))
                held += len(part)
        if con is not None:
            yield closed()

    return written(df.mapInArrow(run, "file binary"))


def read_files(files: DataFrame, table: str, schema: str, *, predicates: list[str] | None = None) -> DataFrame:
    """The rows of a table of write_files that fulfil one of the predicates, which the files' own SQL judges."""
    from pyspark.sql.pandas.types import to_arrow_schema

    form = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    names, kinds = form.names, form.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for data, where in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(data)
                found = con.execute(f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM "{table}" WHERE {where}')
                while some := found.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)
                con.close()

    return files.select("file", F.explode(F.array(*map(F.lit, predicates or ["1"]))).alias("where")).mapInArrow(run, schema)


def append(df: DataFrame, path: str, *, by: tuple[str, ...] = ()) -> None:
    """Adds rows to a Parquet table, in folders by the given columns."""
    (df.write.mode("append").partitionBy(*by) if by else df.write.mode("append")).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, *, batch: int = 500, **options: str) -> None:
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=options)


def write_csv(df: DataFrame, path: str, *, append: bool = False) -> None:
    """A report for people: CSV with a header, in the place of an older one or added to it."""
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
