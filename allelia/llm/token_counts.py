"""Token counts from the exact length histogram."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X
from .tokens import default_path, encoder


def _counts(path: str):
    def make(batches):
        enc = encoder(path)
        for part in X.parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.ids(t)) for t in part.column("text").to_pylist()], pa.int64())], names=["n_tokens"])

    return make


def histogram(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) over documents(text): rows by exact encoded length without special tokens; null text has 0."""
    lengths = documents.select("text").mapInArrow(_counts(path or default_path()), "n_tokens long")
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = 512) -> DataFrame:
    """Per length L of a histogram: documents and tokens of at least L, tokens when all are cut to L, and the share up to L.

    Sums run within blocks of lengths and over the blocks' totals, so no task gets the whole histogram. Lengths are
    distinct, so there are no ties; an empty histogram gives an empty result.
    """
    rows = hist.withColumn("block", F.expr(f"n_tokens div {block}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    per = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    down = Window.orderBy(F.desc("block"))
    per = per.select("block", (F.sum("bd").over(down) - F.col("bd")).alias("d_after"), (F.sum("bt").over(down) - F.col("bt")).alias("t_after"), F.sum("bd").over(Window.partitionBy(F.lit(1))).alias("docs"), F.sum("bt").over(Window.partitionBy(F.lit(1))).alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = rows.join(per, "block").withColumns({"docs_at_least": F.col("d_after") + F.sum("n_docs").over(within), "tokens_at_least": F.col("t_after") + F.sum("tokens").over(within)})
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_truncated"),
        ((F.col("docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs")).alias("share_up_to"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents doesn't exceed."""
    found = [sums.where(F.col("share_up_to") >= q).agg(F.lit(q).alias("share"), F.min("n_tokens").alias("n_tokens")) for q in shares]
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """(tokens): the total when every document is cut to limit tokens."""
    at = sums.agg(F.max(F.when(F.col("n_tokens") <= limit, F.col("tokens_truncated") - F.col("n_tokens") * (F.col("docs_at_least") - F.col("n_docs")))).alias("t"), F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))).alias("d"))
    return at.select((F.coalesce("t", F.lit(0)) + limit * F.coalesce("d", F.lit(0))).alias("tokens"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(X.table(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "histogram"))
