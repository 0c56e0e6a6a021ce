"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X

#: Vectors of a shard at most; out-degree; beam of searches while building and when queried; relaxation of the pruning rule.
SHARD, DEGREE, BEAM, QUERY_BEAM, ALPHA = 32_768, 28, 56, 144, 1.2
#: Out-edges that a node may gather before it is pruned again; nodes expanded at once; queries of a block.
SLACK, WIDE, BLOCK = 32, 2, 256
#: Blocks that one task takes to a graph; rows (graphs, blocks) of an Arrow batch.
LANE, ROWS = 16, 4


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, distances) of the beam nearest nodes that a greedy search from entry finds, for all queries at once, and the nodes
    that each search has met.

    points and queries have unit length; ids are -1 where a search found fewer."""
    n, m = len(queries), len(points)
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    ids[:, 0], open_[:, 0] = entry, True
    dist[:, 0] = 1 - queries @ points[entry]
    seen = np.zeros((n, m + 1), bool)  # the last column takes absent edges
    seen[:, entry] = seen[:, m] = True
    live = np.arange(n)
    while len(live):
        pick = np.argsort(np.where(open_[live], dist[live], np.inf), axis=1, kind="stable")[:, :WIDE]
        is_open = np.take_along_axis(open_[live], pick, 1)
        some = is_open[:, 0]
        live, pick, is_open = live[some], pick[some], is_open[some]
        if not len(live):
            break
        rows = live[:, None]
        open_[rows, pick] = False
        nodes = np.where(is_open, ids[rows, pick], -1)
        new = np.where((nodes >= 0)[:, :, None], edges[nodes], -1).reshape(len(live), -1)
        new = np.where(new < 0, m, new)
        new.sort(axis=1)
        fresh = ~seen[rows, new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[rows, new] = True
        vectors = points[np.where(fresh, new, 0)]
        d = np.where(fresh, 1 - np.einsum("bkd,bd->bk", vectors, queries[live]), np.inf).astype(np.float32)
        all_d = np.concatenate((dist[live], d), 1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(np.concatenate((ids[live], np.where(fresh, new, -1).astype(np.int32)), 1), best, 1)
        open_[live] = np.take_along_axis(np.concatenate((open_[live], fresh), 1), best, 1)
        dist[live] = np.take_along_axis(all_d, best, 1)
    return ids, dist, seen[:, :m].sum(1)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """(own, degree) out-edges: the nearest candidate is taken again and again, and drops those that lie ALPHA times
    nearer to it than to the node itself. Candidates of -1 or the node itself don't count."""
    here = points[own]
    vectors = points[np.maximum(candidates, 0)]
    d = np.maximum(0, 2 - 2 * np.einsum("bkd,bd->bk", vectors, here))  # squared distance of unit vectors
    d[(candidates < 0) | (candidates == own[:, None])] = np.inf
    order = np.argsort(candidates, axis=1, kind="stable")
    again = np.zeros(candidates.shape, bool)
    s = np.take_along_axis(candidates, order, 1)
    np.put_along_axis(again, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
    d[again] = np.inf
    out = np.full((len(own), degree), -1, np.int32)
    row = np.arange(len(own))
    alive = d.copy()
    for k in range(degree):
        best = alive.argmin(1)
        ok = np.isfinite(alive[row, best])
        if not ok.any():
            break
        out[ok, k] = candidates[row, best][ok]
        between = np.maximum(0, 2 - 2 * np.einsum("bkd,bd->bk", vectors, vectors[row, best]))
        alive[(ALPHA**2 * between <= d) | ~ok[:, None]] = np.inf
        alive[row, best] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """(edges, entry) of a graph over unit vectors, by batches that grow with the graph; the order is a fixed shuffle."""
    n = len(points)
    edges = np.full((n, SLACK), -1, np.int32)
    entry = int(np.argmax(points @ points.mean(0)))
    order = np.random.Generator(np.random.PCG64(11)).permutation(n).astype(np.int32)
    order = np.concatenate(([entry], order[order != entry])).astype(np.int32)
    done = 1
    while done < n:
        batch = order[done : done + min(max(1, done // 2), 512)]
        found, _, _ = beam_search(points, edges, entry, points[batch], beam)
        edges[batch, :degree] = robust_prune(points, batch, np.concatenate((found, edges[batch]), 1), degree)
        source, slot = np.nonzero(edges[batch, :degree] >= 0)
        target, source = edges[batch[source], slot], batch[source]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        width = int(many.max())
        incoming = np.full((len(nodes), width), -1, np.int32)
        incoming[np.repeat(np.arange(len(nodes)), many), np.arange(len(target)) - np.repeat(first, many)] = source
        full = np.concatenate((edges[nodes], incoming), 1)
        held = (full >= 0).sum(1)
        packed = np.take_along_axis(full, np.argsort(full < 0, axis=1, kind="stable"), 1)
        fits = held <= SLACK
        edges[nodes[fits]] = packed[fits][:, :SLACK]
        for over in np.array_split(np.flatnonzero(~fits), max(1, -(-(~fits).sum() // 512))):
            if len(over):
                edges[nodes[over]] = -1
                edges[nodes[over], :degree] = robust_prune(points, nodes[over], packed[over][:, : held[over].max()], degree)
        done += len(batch)
    return edges, entry


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square over- or underflows
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; rows whose squares over- or underflow are scaled first."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(all="ignore"):
        sizes = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
        out = (a * b).sum(1) / sizes
    odd = np.flatnonzero(~(np.isfinite(out) & np.isfinite(sizes) & (sizes > 1e-290)))
    if len(odd):
        x, y = (v[odd] / np.abs(v[odd]).max(1, keepdims=True) for v in (a, b))
        out[odd] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return out


def _graph(kind: type):
    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class")
        vectors = np.array(rows["vector"].tolist(), kind)
        edges, entry = build(_unit(vectors))
        ids = rows["ids"].tolist()
        return pd.DataFrame({
            "dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "entry": [entry], "vectors": [vectors.tobytes()], "edges": [edges.tobytes()],
            "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "many": [np.array([len(x) for x in ids], np.int32).tobytes()],
        })

    return make


def _block(kind: type):
    def make(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "block": [rows["block"].iloc[0]], "classes": [rows["class"].to_numpy(np.int64).tobytes()], "queries": [np.array(rows["vector"].tolist(), kind).tobytes()]})

    return make


def _search(k: int, beam: int, kind: type):
    """Over a partition's rows in order: a graph, then the blocks of queries that search it."""

    def make(batches):
        graph = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["queries"] is None:
                    vectors = np.frombuffer(r["vectors"], kind).reshape(-1, r["dim"])
                    many = np.frombuffer(r["many"], np.int32)
                    graph = vectors, _unit(vectors), np.frombuffer(r["edges"], np.int32).reshape(-1, SLACK), r["entry"], many, np.append(0, np.cumsum(many)), np.frombuffer(r["ids"], np.int64)
                    continue
                vectors, points, edges, entry, many, at, ids = graph
                queries, classes = np.frombuffer(r["queries"], kind).reshape(-1, r["dim"]), np.frombuffer(r["classes"], np.int64)
                found = beam_search(points, edges, entry, _unit(queries), max(beam, k + 1))[0][:, : k + 1]
                q, slot = np.nonzero(found >= 0)
                node = found[q, slot]
                score = cosines(queries[q], vectors[node])
                times = many[node]
                member = np.repeat(at[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(classes[q], times)), pa.array(ids[member]), pa.array(np.repeat(score, times))], names=["class", "vec_id", "score"])

    return make


def nearest(embeddings: DataFrame, is_query, k: int = 5, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of embeddings(vec_id, embedding) that meets is_query, the k nearest
    other rows found, by cosine in double precision on the original vectors, ties to the smaller vec_id.

    Rows with a null id, vectors that are null, empty, zero or hold null or non-finite components take no part; vectors
    of different lengths aren't compared. Equal vectors are one node, known by its k + 1 smallest ids, so a group of
    copies of any size is found whole as far as k needs. Nodes are dealt by hash to as few shards of about SHARD as hold
    them; each shard has a graph, and each block of queries searches each shard, where a search meets a number of nodes
    that hardly grows with the shard (a test counts them). Vectors of floats are kept as floats, others as doubles;
    distances in the search are single precision, scores double. Fewer candidates give fewer rows.
    """
    kind = np.float32 if embeddings.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    usable = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)")
    rows = embeddings.where(usable).select("vec_id", F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>").alias("vector"))
    salts = rows.count() // 100_000 + 64
    least = lambda x: F.slice(F.array_sort(F.array_distinct(x)), 1, k + 1)
    classes = rows.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("salt")).agg(least(F.collect_set("vec_id")).alias("ids"))
    classes = classes.groupBy("vector").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    classes = X.table(classes.select(F.col("ids")[0].alias("class"), F.size("vector").alias("dim"), "vector", "ids"), "vectors")
    shards = -(-classes.count() // SHARD) or 1
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int"))
    graphs = dealt.groupBy("dim", "shard").applyInPandas(_graph(kind), "dim int, shard int, entry int, vectors binary, edges binary, ids binary, many binary")
    graphs = X.table(graphs, "graphs")
    asked = rows.where(is_query).withColumn("dim", F.size("vector"))
    asked = X.table(asked.join(classes.select("vector", "class"), "vector").select("vec_id", "class", "dim", "vector"), "queries")
    unique = asked.groupBy("class", "dim").agg(F.first("vector").alias("vector"))
    blocks = -(-unique.count() // BLOCK) or 1
    unique = unique.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int"))
    unique = unique.groupBy("dim", "block").applyInPandas(_block(kind), "dim int, block int, classes binary, queries binary")
    # each graph goes to its lanes' tasks, followed there by the lane's blocks
    lanes = -(-blocks // LANE)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks_of = unique.withColumn("lane", F.col("block") % lanes).drop("block").withColumn("shard", every(shards))
    both = graphs.withColumn("lane", every(lanes)).unionByName(blocks_of, allowMissingColumns=True).repartition("dim", "shard", "lane")
    both = both.sortWithinPartitions("dim", "shard", "lane", F.col("queries").isNotNull())
    found = both.select("dim", "entry", "vectors", "edges", "ids", "many", "classes", "queries").mapInArrow(_search(k, beam, kind), "class long, vec_id long, score double")
    near = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    found = found.dropDuplicates(["class", "vec_id"]).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).drop("r")
    with X.small_batches(embeddings.sparkSession, ROWS):  # a graph is a large row
        found = X.table(found, "found")  # written, so that a vector that many queries have is split in the join
    own = asked.select(F.col("vec_id").alias("query_id"), "class").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = own.join(found, "class").where("query_id <> vec_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
