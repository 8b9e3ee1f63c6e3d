"""From raw documents to token ids: quality, near duplicates, repeated passages, benchmark passages, encoding.

Every stage takes (spark, docs, sf_dir), works on all of docs, and but for the last returns the columns of
documents. A null or empty text is a document like any other; a document that loses all of its text to the
third stage stays, empty. Rows with a null id take part, before any other id. Repeated rows are near duplicates, so the second
stage keeps one. Further columns of any name are carried along. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import bpe, chunks, decontaminate, near, quality, queries, repeats


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the columns other than text in one struct, so that their names clash with none of an operator's."""
    return docs.select("doc_id", "text", F.struct(*(docs[c].alias(f"f{k}") for k, c in enumerate(docs.columns) if c != "text")).alias("__rest"))


def unpacked(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs, those of new in their place."""
    return found.select(*((new[c] if c in new else F.col("text") if c == "text" else F.col("__rest")[f"f{k}"]).alias(c) for k, c in enumerate(docs.columns)))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half go."""
    scored = quality.score(packed(docs), queries.table(spark, sf_dir, "labels"), keep=("text", "__rest"))
    return unpacked(scored.where("predicted = 1"), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    return unpacked(near.near_duplicates(packed(docs), keep=("text", "__rest")).where("is_first"), docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier in the corpus go; n_chars follows the text."""
    kept = repeats.remove_repeats(packed(docs), keep=("__rest",), as_text=True)
    return unpacked(kept, docs, text=F.col("kept_text"), n_chars=F.length("kept_text").cast(docs.schema["n_chars"].dataType))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    found = decontaminate.decontaminate(packed(docs), queries.table(spark, sf_dir, "benchmark"), keep=("text", "__rest"))
    return unpacked(found.where(F.size("hits") == 0), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding the ids gave the text back."""
    return bpe.encode(docs, queries.CODEC_VOCABULARY, keep=("doc_id", "lang", "source"), check=True)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", remove_repeated_passages),
    ("benchmark decontamination", reject_contaminated),
    ("byte-level BPE", encode),
]
#: The classifier and the encoder are beyond SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents; each result is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = chunks.written(docs)
    return docs
