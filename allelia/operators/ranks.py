"""Ranks over a whole column without a task that holds it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt to; a range's count is a row of the driver's table of offsets.
RANGES = 256


def value_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(column, same, below, n): each distinct value that isn't null, its rows, the rows of smaller values, and all rows.

    Values are cut at approximate quantiles, which gives at most RANGES ranges whatever the number of rows; each range
    ranks its own values and adds the counts of the ranges before it. Equal values are one row, however common."""
    some = rows.where(F.col(column).isNotNull())
    shares = ", ".join(str(i / RANGES) for i in range(1, RANGES))
    cuts = sorted(set(some.agg(F.expr(f"approx_percentile(`{column}`, array({shares}), 10000)").alias("c")).first().c or []))
    block = F.lit(0)
    if cuts:  # the first cut that isn't below the value; 0 where all are
        block = F.array_position(F.transform(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col(column)), True).cast("int")
    sizes = some.groupBy(column).agg(F.count("*").alias("same")).withColumn("block", F.when(block == 0, len(cuts) + 1).otherwise(block))
    before, n = {}, 0
    for r in sorted(sizes.groupBy("block").agg(F.sum("same").alias("m")).collect()):  # at most RANGES rows
        before[r.block], n = n, n + r.m
    offset = F.create_map(*[F.lit(x) for item in (before or {0: 0}).items() for x in item])[F.col("block")].cast("long")
    inner = F.sum("same").over(Window.partitionBy("block").orderBy(column)) - F.col("same")
    return sizes.select(column, "same", (offset + inner).alias("below"), F.lit(n).cast("long").alias("n"))
