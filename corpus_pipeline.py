"""The corpus pipeline: stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from allelia.llm import decontaminate, near_dedup, packing, secret_scan, text, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model rejects go; it learns from labels of the rows that op10 learns from. Null
    and empty texts score as the model's bias and stay; rows that share or lack an id are each judged by their text."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out())
    return toxicity.without_toxic(docs, model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, at a similarity of 0.8 or more: that with the smallest doc_id, of
    identical rows any one. Rows without words or without an id stay; a text is judged by itself, whatever shares its id."""
    return near_dedup.without_near_duplicates(docs, threshold=80)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each judged by its own text, with an id or without. Null texts stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by a mark, and n_chars follows the text."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document in the packed sequences; null and empty texts have a piece with the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_duplicates_out),
    ("decontamination", leaks_out),
    ("secret_scan", secrets_out),
    ("packing", packed),
]
#: No SQL: a learned model, connected components and tokenizer ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = text.table(docs, name)
    return docs
