"""Canonical DataFrames: calls, variants, samples, genes. Here they are derived from star-schema tables.

calls(variant_id, sample_id, g, gd, gq) is sparse: absent pairs are hom-ref (0), a null g is a missing call. Every
operator reconstructs the zeros by complement from the number of samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items of a partition on average; tables with more are dealt to a number of partitions that grows with them.
ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in partitions of about ROWS of rows, at least as many as a shuffle has; as it is, if two of them hold all."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS)), *keys) if rows > 2 * ROWS else df


def carried(spark: SparkSession, sf_dir: str, *columns: str, where: str = "true", by: tuple = ("variant_id", "sample_id")) -> DataFrame:
    """(variant_id, sample_id, columns) of the line items, dealt by variant and sample (or one of them), so that a task's aggregate stays bounded."""
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.count()
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sample_id"))
    lines = lines.where(where).select("l_orderkey", F.col("l_partkey").alias("variant_id"), *columns)
    out = dealt(lines, rows, "l_orderkey").join(dealt(orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return dealt(out.select("variant_id", "sample_id", *columns), rows, *by)


def calls(spark: SparkSession, sf_dir: str, complete: bool = False, by: tuple = ("variant_id", "sample_id")) -> DataFrame:
    """Carriers and missing calls; with complete, no call is missing. Dealt by variant alone, they meet their variant without a shuffle."""
    out = carried(spark, sf_dir, "l_quantity", "l_linenumber", by=by).groupBy("variant_id", "sample_id").agg(
        F.least(F.count("*"), F.lit(2)).cast("int").alias("g"), F.sum("l_quantity").cast("long").alias("gd"), F.max("l_linenumber").alias("gq")
    )
    if complete:
        return out
    return out.withColumn("g", F.when((F.col("variant_id") * 31 + F.col("sample_id") * 17) % 23 != 0, F.col("g")))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("variant_id"), (F.col("p_size") % 22 + 1).cast("int").alias("chrom"), (1000 * (F.col("p_partkey") + 1)).alias("pos"),
        F.col("p_brand").alias("gene"), F.col("p_type").alias("anno"), F.col("p_retailprice").alias("qual"),
        F.expr("substr('ACGT', int(p_partkey % 4 + 1), 1)").alias("ref"), F.expr("substr('CGTA', int(p_partkey % 4 + 1), 1)").alias("alt"),
        F.expr("CASE p_partkey % 7 WHEN 0 THEN 'q10' WHEN 1 THEN 'q10;s50' ELSE 'PASS' END").alias("filter"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sample_id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("y"),
        F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(1).alias("trait"), (F.col("c_custkey") % 2 + 1).cast("int").alias("sex"),
        F.col("c_nationkey").alias("c1"), (F.col("c_custkey") % 5).cast("int").alias("c2"), F.concat(F.lit("F"), F.col("c_nationkey")).alias("fid"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(
        F.col("n_name").alias("gene"), (F.col("n_nationkey") % 22 + 1).cast("int").alias("chrom"),
        (F.col("n_nationkey") * 40000).cast("long").alias("beg"), (F.col("n_nationkey") * 40000 + 400000).cast("long").alias("end"),
    )


#: The same views for the oracle, to be followed by SELECT or further CTEs.
SQL = """WITH c0 AS (SELECT l_partkey AS variant_id, o_custkey AS sample_id, CAST(LEAST(COUNT(*), 2) AS INTEGER) AS g,
  CAST(SUM(l_quantity) AS BIGINT) AS gd, CAST(MAX(l_linenumber) AS INTEGER) AS gq FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
calls AS (SELECT variant_id, sample_id, CASE WHEN (variant_id * 31 + sample_id * 17) % 23 <> 0 THEN g END AS g, gd, gq FROM c0),
variants AS (SELECT p_partkey AS variant_id, CAST(p_size % 22 + 1 AS INTEGER) AS chrom, 1000 * (p_partkey + 1) AS pos, p_brand AS gene, p_type AS anno,
  p_retailprice AS qual, substr('ACGT', p_partkey % 4 + 1, 1) AS ref, substr('CGTA', p_partkey % 4 + 1, 1) AS alt,
  CASE p_partkey % 7 WHEN 0 THEN 'q10' WHEN 1 THEN 'q10;s50' ELSE 'PASS' END AS filter FROM part),
samples AS (SELECT c_custkey AS sample_id, CAST(ROUND(c_acctbal * 100) AS BIGINT) AS y, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS trait,
  CAST(c_custkey % 2 + 1 AS INTEGER) AS sex, c_nationkey AS c1, CAST(c_custkey % 5 AS INTEGER) AS c2, 'F' || c_nationkey AS fid FROM customer),
genes AS (SELECT n_name AS gene, CAST(n_nationkey % 22 + 1 AS INTEGER) AS chrom, CAST(n_nationkey * 40000 AS BIGINT) AS beg,
  CAST(n_nationkey * 40000 + 400000 AS BIGINT) AS fin FROM nation),
n AS (SELECT COUNT(*) AS n FROM samples)
"""
