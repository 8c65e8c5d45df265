"""From raw documents to packed training sequences, in stages that are each written as Parquet and read again.

A stage decides by row, also where rows share a doc_id or have none: each numbers its rows when it writes its input and
filters by those numbers. Null texts count as empty, very long ones are read whole. An empty table stays empty through
all stages. Columns beside doc_id and text are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from riskloom.llm.common import new_folder, table, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written with a number for each row, and that column's name, which docs doesn't have."""
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return written(numbered, "rows", new_folder(docs.sparkSession, "pipeline"), compression="zstd"), row


def _only(numbered: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows whose number is in kept's only column, without the number."""
    return numbered.join(kept.toDF(row), row, "left_semi").drop(row)


def _by_row(numbered: DataFrame, row: str) -> DataFrame:
    """Rows for an operator that carries doc_id only: their number stands for it."""
    return numbered.select(F.col(row).alias("doc_id"), "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rows, row = _numbered(docs)
    return _only(rows, row, quality.classify(rows, table(spark, sf_dir, "labels"), row).filter("predicted = 1").select(row))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (nulls last); of such rows repeated, that with the largest number."""
    rows, row = _numbered(docs)
    found = written(exact_dedup.exact_dedup(_by_row(rows, row)).select(F.col("doc_id").alias("at"), "keep_id", "group_size"), "groups", new_folder(spark, "pipeline"))
    ids = rows.select(F.col(row).alias("at"), F.col("doc_id").cast("long").alias("doc_id"))
    last = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "at"))
    chosen = found.filter("group_size > 1").join(ids, "at").groupBy("keep_id").agg(last.alias("last")).select("last.at")
    return _only(rows, row, found.filter("group_size = 1").select("at").unionByName(chosen))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) one row with the smallest doc_id stays (nulls last)."""
    rows, row = _numbered(docs)
    found = jaccard_join.jaccard_components(_by_row(rows, row)).select(F.col("doc_id").alias("at"), "component_id")
    ids = rows.select(F.col(row).alias("at"), F.col("doc_id").cast("long").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))
    return _only(rows, row, found.join(ids, "at").groupBy("component_id").agg(first.alias("first")).select("first.at"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, row = _numbered(docs)
    return _only(rows, row, decontaminate.report(_by_row(rows, row), table(spark, sf_dir, "benchmark")).filter("not contaminated").select("doc_id"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents kept, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: A classifier and a tokenizer are no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}", folder)
    return docs
