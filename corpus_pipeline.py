"""The corpus pipeline: from raw documents to packed training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each stage's result is written
as Parquet and read again as the docs of the next, so that a stage starts without lineage and any executor may be lost.
All stages but the last return the columns of documents; n_chars follows the text where a stage changes it. run() deletes a stage's table once the
next one is written, and what a stage stored on its way once its result is.

Defined results, those of the operators: a null text is an empty one and stays, empty, unless the classifier rejects it; rows that repeat whole are
near duplicates of each other, so that one stays, and rows without words are in no group and stay; texts of any length are read whole; an empty table
gives empty tables; further columns of documents, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from lectern.llm.common import forget, scope, store, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of five documents or more stay in the last of them only; a document left without lines stays, empty."""
    kept = line_dedup.dedup_lines(docs)
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows joined by links of word five-grams, one stays: that of the least doc_id."""
    return jaccard_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole but for a few edits, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the documents in sequences of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    stored = None
    for _, stage in STAGES:
        with scope() as keep:
            docs = keep(store(stage(spark, docs, sf_dir)))
        if stored is not None:
            forget(stored)
        stored = docs
    return docs
