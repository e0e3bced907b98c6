"""Corpus pipeline: quality rules, toxicity, exact and near duplicates, packing.

Each stage takes the documents that the stage before has kept, as a table, and returns
documents of the same columns, except the last, which returns where each piece of a
document is packed.  Null, empty and repeated rows follow the operators' rules: texts
under the base counts of the quality rules (so null and empty ones) are rejected by the
first stage; of repeated rows one stays; rows with null or equal ids are judged each on
its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, line_rules, near_dedup, packing, toxicity
from driftline.llm.shared import new_path, numbered, table, without_rows

ROW = "__driftline_row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules, without their boilerplate lines."""
    return line_rules.clean_documents(docs)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    rows = numbered(docs, ROW)
    dropped = exact_dedup.exact_duplicates(rows, row_col=ROW).where(~F.col("kept")).select(F.col("row").alias(ROW))
    return without_rows(rows, dropped, ROW).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the first of the table."""
    rows = numbered(docs, ROW)
    dropped = near_dedup.near_duplicates(rows, id_col=ROW).where(F.col("id") != F.col("component_id")).select(F.col("id").alias(ROW))
    return without_rows(rows, dropped, ROW).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document is packed."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", non_toxic),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: Trained and iterative stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = new_path(spark, f"stage-{number}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
