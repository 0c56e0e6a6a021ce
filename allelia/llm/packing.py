"""Harmonic packing of token sequences."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X
from .tokens import default_path, encoder

#: A remainder below this isn't cut any more.
TAIL = 64
#: Pieces that one group numbers.
SHARD = 2000


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then the largest capacity // k that fits, then a tail under TAIL."""
    out = [capacity] * (n // capacity)
    left = n % capacity
    while left >= min(TAIL, capacity):
        k = -(-capacity // left)
        out.append(capacity // k)
        left -= capacity // k
    return out + [left] * (left > 0)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def make(batches):
        enc, salt = encoder(path), 0
        for part in X.parts(batches):
            rows = {k: [] for k in ("doc_id", "start", "length", "crc", "total", "salt", "ids")}
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = enc.ids(text).tobytes() + end
                at, salt = 0, salt + 1
                for n in cut(len(ids) // 4, capacity):
                    own = ids[4 * at : 4 * (at + n)]
                    rows["doc_id"].append(doc)
                    rows["start"].append(at)
                    rows["length"].append(n)
                    rows["crc"].append(zlib.crc32(own))
                    rows["total"].append(len(ids) // 4)
                    rows["salt"].append(salt)
                    rows["ids"].append(own if with_ids else None)
                    at += n
            kinds = [*[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt", "ids"])

    return make


def _first_fit(capacity: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True], kind="stable")
        room: list[int] = []
        where, at = [], []
        low = 0
        last = None
        for n in rows["length"].tolist():
            if n != last:
                low, last = 0, n
            while low < len(room) and room[low] < n:
                low += 1
            if low == len(room):
                room.append(capacity)
            where.append(low)
            at.append(capacity - room[low])
            room[low] -= n
        return rows.assign(sequence_id=rows["base"] + where, offset=at).drop(columns="base")

    return fit


def pack(documents: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece of documents(doc_id, text): where its ids lie in which sequence of capacity ids at most.

    Every row's ids end with end_id; null or empty texts have only that. Remainders are cut to lengths capacity // k, so
    a length's class takes exactly capacity // length pieces a sequence and wastes under that many ids. Pieces are
    numbered within (length, shard) groups of about SHARD rows, each group from its own offset, so workers fill
    sequences independently and any group may be as hot as it likes. Each length leaves one unfilled sequence at most;
    these pieces, under 12,000 whatever the input, are packed together by first fit. Rows that repeat are each packed,
    and so are different texts under one id or without one; an empty table gives an empty result; with_ids keeps the
    pieces' ids (little-endian unsigned 32-bit).
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long, ids binary"
    pieces = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(path or default_path(), capacity, end_id, with_ids), schema)
    pieces = X.table(pieces if with_ids else pieces.drop("ids"), "pieces")
    shards = pieces.count() // SHARD + 1
    # the salt, a number within the task that was written with the piece, spreads rows that share or lack a doc_id
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(shards))).drop("salt")
    counts = X.table(pieces.groupBy("length", "shard").agg(F.count("*").alias("n")), "shards")
    by_length = Window.partitionBy("length")
    before = counts.withColumn("before", F.sum("n").over(by_length.orderBy("shard")) - F.col("n")).drop("n")
    # at most one row a length: capacity // k and lengths under TAIL
    total = counts.groupBy("length").agg(F.sum("n").alias("of")).withColumn("full", F.expr(f"`of` div ({capacity} div length)"))
    total = total.withColumn("base", F.sum("full").over(Window.orderBy("length")) - F.col("full")).withColumn("after", F.sum("full").over(Window.partitionBy(F.lit(1))))
    rank = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    placed = pieces.withColumn("r", F.row_number().over(rank)).join(before, ["length", "shard"]).join(F.broadcast(total), "length")
    placed = placed.withColumn("k", F.expr(f"{capacity} div length")).withColumn("at", F.col("before") + F.col("r") - 1)
    # written once: both branches below see the same ranks, whatever the order of rows that tie in all columns
    placed = X.table(placed.withColumn("bin", F.expr("at div k")), "placed")
    names = [*pieces.drop("shard").columns, "sequence_id", "offset"]
    whole = placed.where("bin < full").select("*", (F.col("base") + F.col("bin")).alias("sequence_id"), F.expr("(at % k) * length").alias("offset")).select(names)
    rest = placed.where("bin >= full").select(*pieces.drop("shard").columns, F.col("after").alias("base"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.drop("shard").schema) + ", sequence_id long, offset long"
    rest = rest.groupBy("base").applyInPandas(lambda rows: _first_fit(capacity)(rows)[names], kind)
    return whole.unionAll(rest.select(names))


def sequences(documents: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """(sequence_id, tokens, input_ids): the packed sequences themselves, padded to capacity unless their length is a power of two.

    Null and empty texts give end_id alone; repeated rows are each packed; an empty table gives an empty result."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(rows.sort_values("offset")["ids"])
        n = len(ids) // 4
        full = n if n & (n - 1) == 0 else capacity
        values = [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]
        return pd.DataFrame({"sequence_id": [rows["sequence_id"].iloc[0]], "tokens": [n], "input_ids": [values + [pad_id] * (full - n)]})

    packed = pack(documents, path, capacity, end_id, with_ids=True)
    return packed.groupBy("sequence_id").applyInPandas(join, "sequence_id long, tokens long, input_ids array<int>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
