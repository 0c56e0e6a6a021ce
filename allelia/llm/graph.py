"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import passing_tables, table

#: Edges up to which the nodes' least neighbours are broadcast.
BROADCAST_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges(a, b), for every id that has an edge.

    Alternates large-star and small-star steps until no edge changes: the number of rounds grows with the logarithm
    of the diameter, and each step is one aggregation by node with map-side combining and one join. The stars' edges are
    as many as the edges at most. Each node's least neighbour is broadcast while there are few edges, else written before
    the join, so that Spark can split a hub's edges among tasks. Null ends and loops are ignored; repeated edges count once.
    """
    now = table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        with passing_tables(edges.sparkSession) as passing:
            few = mark[0] <= BROADCAST_EDGES
            side = F.broadcast if few else lambda df: passing(df, "least")
            both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = side(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = passing(large.where("a <> b").distinct(), "large")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(side(least), "a")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
            now = table(small.where("a <> b").distinct(), "small")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    least = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return least.select(F.col("a").alias("id"), "component").unionAll(roots.join(least, roots.id == least.a, "left_anti"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
