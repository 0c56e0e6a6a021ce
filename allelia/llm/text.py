"""Byte-level numpy kernels for words and shingles, and shared scratch tables.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; these bytes are ASCII, so the split of the
UTF-8 bytes equals the split of the text. Words and word sequences are known by 64-bit hashes of their bytes.
Null text counts as empty. Slabs bound the kernels' memory whatever the size of an Arrow batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLAB_BYTES = 3 << 18
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_NO_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
_RAW = np.random.Generator(np.random.PCG64(20240917)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOW = _RAW.copy()
_LOW[65:91] = _RAW[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the word-hash base, kept for later calls while they are few."""
    global _powers
    if n > len(_powers):
        out = np.full(max(n, 4096), _BASE, np.uint64)
        out[0] = 1
        out = np.cumprod(out)
        if len(out) > 1 << 20:
            return out
        _powers = out
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slabs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, offsets from 0, bytes) of consecutive rows with about SLAB_BYTES, at least one row each."""
    at, data = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLAB_BYTES, "right")) - 1)
        yield i, j, at[i : j + 1] - at[i], data[at[i] : at[j]]
        i = j


def words(at: np.ndarray, data: np.ndarray, lower: bool, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slab: (hash of each word, index of each row's first word with the end appended, word starts, word ends).

    With letters, all ASCII but letters separates words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none
    solid = ~(_NO_LETTER if letters else _WS)[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    firsts = at[:-1][at[:-1] < n]
    begin[firsts] = solid[firsts]
    starts = np.flatnonzero(begin)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none
    before = np.zeros(n + 1, np.int64)  # solid bytes before each byte
    np.cumsum(solid, out=before[1:])
    packed = before[starts]  # each word's place among the solid bytes
    lens = np.diff(np.append(packed, before[-1]))
    inside = np.arange(before[-1], dtype=np.int64) - np.repeat(packed, lens)
    value = (_LOW if lower else _RAW)[data[solid]]
    value *= powers(int(lens.max()))[inside]
    hashes = np.add.reduceat(value, packed)
    hashes += lens.astype(np.uint64) * _STEP
    return mix(hashes), np.searchsorted(starts, at), starts, starts + lens


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes (rows' bounds are the caller's matter); as long as h less n-1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    block, size = h, 1
    left = n
    while left:
        if left & 1:
            m = len(h) - n + 1
            part = block[done : done + m]
            out = part.copy() if out is None else out * _power_of_step(size) + part
            done += size
        left >>= 1
        if left:
            block = block[: len(block) - size] * _power_of_step(size) + block[size:]
            size *= 2
    return mix(out + np.uint64(n * int(_BASE) % (1 << 64)))


def _power_of_step(k: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), k, 1 << 64))


def shingles(h: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word n-grams of each row; a row with 1 to n-1 words has its whole sequence as one.

    (hashes, row of each, word position of each), in row and position order."""
    count = np.diff(first)
    whole = runs(h, n)
    out, row, pos = [], [], []
    full = np.flatnonzero(count >= n)
    if len(full):
        many = count[full] - n + 1
        r = np.repeat(full, many)
        p = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append(whole[first[r] + p])
        row.append(r)
        pos.append(p)
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            out.append(runs(h, k)[first[few]])
            row.append(few)
            pos.append(np.zeros(len(few), np.int64))
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    row = np.concatenate(row)
    order = np.argsort(row, kind="stable")
    return np.concatenate(out)[order], row[order], np.concatenate(pos)[order]


def arrow_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and each row's count."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; set here only where it is unset (tests, local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Rows of an Arrow batch at most while a table is written: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 512


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within the block, the session's setting has that value; after it, the one it had before, or none."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Within the block, the session's Arrow batches have so many rows at most; after it, what they had before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if 0 < int(spark.conf.get(key)) <= rows:
        yield
    else:
        with setting(spark, key, str(rows)):
            yield


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: the lineage is cut and lost executors lose nothing."""
    return _written(df, scratch(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession):
    """Gives a function like table() whose tables are deleted when the block ends: what leaves the block is written
    before that, and refers to none of them."""
    made: list[str] = []

    def make(df: DataFrame, name: str) -> DataFrame:
        made.append(scratch(spark, name))
        return _written(df, made[-1])

    try:
        yield make
    finally:
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of BATCH_ROWS at most."""
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(k, BATCH_ROWS)


#: Rows' keys that are broadcast at most.
BROADCAST_KEYS = 200_000


def row_key() -> Column:
    """A row of documents by its doc_id and 128 bits of hash of its text: rows that share or lack an id stay apart, only
    rows with the same id (or none) and the same text are one. As a struct, a null id equals a null id."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def _joined(documents: DataFrame, keys: DataFrame, how: str) -> tuple[DataFrame, str]:
    """documents joined with keys(row) by row_key(), and the name of the column with the key, which documents doesn't have."""
    name = "row_key"
    while name in (c.lower() for c in documents.columns):
        name += "_"
    few = keys.count() <= BROADCAST_KEYS
    keys = keys.select(F.col("row").alias(name))
    return documents.withColumn(name, row_key()).join(F.broadcast(keys) if few else keys, name, how), name


def only(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of documents whose row_key() is in keys(row), a written table. Texts are shuffled only for more than
    BROADCAST_KEYS keys."""
    found, name = _joined(documents, keys, "left_semi")
    return found.drop(name)


def without(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of documents whose row_key() isn't in keys(row). Texts are shuffled only for more than BROADCAST_KEYS keys."""
    found, name = _joined(documents, table(keys.select("row").distinct(), "keys"), "left_anti")
    return found.drop(name)


def once(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """documents with one row for each row_key() in keys(row), a written table of distinct keys; other rows all stay."""
    some, name = _joined(documents, keys, "left_semi")
    return _joined(documents, keys, "left_anti")[0].unionByName(some.dropDuplicates([name])).drop(name)
