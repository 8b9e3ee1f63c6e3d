"""Nested call transcripts: from tables to JSON and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = "struct<turn:bigint,speaker:string,text:string,start:double,end:double>"
SCHEMA = f"struct<call_id:bigint,metadata:struct<duration:double,channels:int>,results:struct<channels:array<struct<alternatives:array<struct<paragraphs:struct<paragraphs:array<struct<sentences:array<{SENTENCE}>>>>>>>>>>"


def nested(turns: DataFrame) -> DataFrame:
    """One JSON transcript per conversation (column json): a paragraph of one sentence for each turn."""
    sentence = F.struct("turn", F.col("role").alias("speaker"), "text", F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"))
    rows = turns.groupBy(F.col("conv_id").alias("call_id")).agg(F.array_sort(F.collect_list(sentence), lambda a, b: F.when(a.turn < b.turn, -1).when(a.turn > b.turn, 1).otherwise(0)).alias("s"))
    paragraphs = F.struct(F.transform("s", lambda x: F.struct(F.array(x).alias("sentences"))).alias("paragraphs"))
    results = F.struct(F.array(F.struct(F.array(F.struct(paragraphs.alias("paragraphs"))).alias("alternatives"))).alias("channels"))
    return rows.select(F.to_json(F.struct("call_id", F.struct(F.size("s").cast("double").alias("duration"), F.lit(1).alias("channels")).alias("metadata"), results.alias("results"))).alias("json"))


def parse(lines: DataFrame, column: str = "json") -> DataFrame:
    """JSON text to the nested record; malformed text gives a record of NULLs."""
    return lines.select(F.from_json(column, SCHEMA).alias("t")).select("t.*")


def read(spark, path: str) -> DataFrame:
    """A folder of transcript files, one JSON document each, with the file's name."""
    schema = spark.createDataFrame([], f"t {SCHEMA}").select("t.*").schema
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def sentences(calls: DataFrame) -> DataFrame:
    """One row per sentence of the first alternative of the first channel, without repeats."""
    first = F.try_element_at(F.try_element_at("results.channels", F.lit(1)).alternatives, F.lit(1)).paragraphs.paragraphs
    rows = calls.select("call_id", F.explode(first).alias("p")).select("call_id", F.explode("p.sentences").alias("s"))
    return rows.select("call_id", "s.turn", "s.speaker", "s.text").dropDuplicates()
