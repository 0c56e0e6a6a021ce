"""Substring dedup by relative Lempel-Ziv factors against an index of the whole corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X

#: Words of a window; of an anchor. Every window holds ROLL anchor places, of which those with the least hash count.
WINDOW, ANCHOR = 20, 6
ROLL = WINDOW - ANCHOR + 1
NO_ID = -(1 << 63)
RUNS = "array<struct<start: int, words: int, source: long, source_start: int>>"


def _rolling(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over each n consecutive values."""
    size = 1
    out = x
    while size * 2 <= n:
        out = op(out[:-size], out[size:])
        size *= 2
    return out if size == n else op(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1])


class Anchors:
    """Of a slab: hashes of words and anchors, each window's least anchor hash (0 where no window starts), chosen places."""

    def __init__(self, at: np.ndarray, data: np.ndarray):
        self.h, self.first, self.starts, self.ends = X.words(at, data, lower=False)
        n = len(self.h)
        count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(count)), count)
        self.end = np.repeat(self.first[1:], count)
        self.begin = np.repeat(self.first[:-1], count)
        self.least, self.chosen = np.zeros(n, np.uint64), np.zeros(0, np.int64)
        if n < WINDOW:
            return
        self.anchor = X.runs(self.h, ANCHOR)
        least = _rolling(self.anchor, ROLL, np.minimum)
        least[np.arange(len(least)) + WINDOW > self.end[: len(least)]] = 0
        self.least[: len(least)] = least
        most = _rolling(np.append(np.zeros(ROLL - 1, np.uint64), self.least), ROLL, np.maximum)
        self.chosen = np.flatnonzero((most[: len(self.anchor)] == self.anchor) & (np.arange(len(self.anchor)) + ANCHOR <= self.end[: len(self.anchor)]))

    def contexts(self) -> np.ndarray:
        """A hash of the words of all windows around each chosen place, as far as its row goes."""
        p = self.chosen
        a, b = np.maximum(self.begin[p], p - ROLL + 1), np.minimum(self.end[p], p + WINDOW)
        power = X.powers(len(self.h) + 1)[: len(self.h) + 1]
        back = np.full(len(self.h) + 1, np.uint64(pow(int(X._BASE), -1, 1 << 64)))
        back[0] = 1
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(self.h * power[:-1]))
        return X.mix((sums[b] - sums[a]) * np.cumprod(back)[a] + (p - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (b - p).astype(np.uint64) * np.uint64(0xC13FA9A902A6328F))


#: A row: its doc_id (NO_ID for null) and, where others share or lack it too, 128 bits of hash of its text.
KEY = ["id", "t1", "t2"]


def _keys(batch, i: int, j: int, row: np.ndarray) -> list[pa.Array]:
    return [pa.array(batch.column(c).slice(i, j - i).to_numpy(zero_copy_only=False)[row]) for c in KEY]


def _anchors(with_context: bool):
    def make(batches):
        for batch in batches:
            for i, j, at, data in X.slabs(batch.column("text")):
                x = Anchors(at, data)
                if not len(x.chosen):
                    continue
                out = [pa.array(X.signed(x.anchor[x.chosen]))]
                if with_context:
                    out += [pa.array(X.signed(x.contexts())), *_keys(batch, i, j, x.row[x.chosen]), pa.array((x.chosen - x.begin[x.chosen]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=["anchor", "context", *KEY, "at"][: len(out)])

    return make


def _windows(batches):
    """The windows whose least anchor lies at one of the row's open places."""
    for batch in batches:
        places = batch.column("places")
        for i, j, at, data in X.slabs(batch.column("text")):
            x = Anchors(at, data)
            own = places.slice(i, j - i)
            counts = np.array([len(v) for v in own.to_pylist()], np.int64)
            p = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(x.first[:-1], counts)
            start = np.maximum(0, p[:, None] - np.arange(ROLL)[None, :])
            ok = (start >= x.begin[p][:, None]) & (x.least[start] == x.anchor[p][:, None]) & (np.arange(ROLL)[None, :] <= p[:, None])
            start = np.unique(start[ok])
            if len(start):
                one = X.runs(x.h, WINDOW)[start]
                two = X.runs(X.mix(x.h ^ np.uint64(0x2545F4914F6CDD1D)), WINDOW)[start]
                yield pa.RecordBatch.from_arrays([pa.array(X.signed(one)), pa.array(X.signed(two)), *_keys(batch, i, j, x.row[start]), pa.array((start - x.begin[start]).astype(np.int32))], names=["one", "two", *KEY, "at"])


def keyed(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) with KEY. Only for ids that repeat (a written table, broadcast while small) or are null are
    texts hashed: elsewhere the id is enough."""
    ids = documents.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("c")).where("c > 1")
    ids = X.table(ids.select("id", F.lit(True).alias("again")), "shared_ids")
    many = ids.count()
    docs = documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    docs = docs.join(F.broadcast(ids) if many <= X.BROADCAST_KEYS else ids, "id", "left") if many else docs.withColumn("again", F.lit(False))
    again = F.coalesce("again", F.lit(False)) | F.col("doc_id").isNull()
    return docs.select("doc_id", "text", "id", *[F.when(again, F.xxhash64(F.lit(k), "text")).otherwise(F.lit(0).cast("long")).alias(f"t{k}") for k in (1, 2)])


def duplicate_runs(documents: DataFrame) -> DataFrame:
    """(id, t1, t2, runs) of documents(text, id, t1, t2), see keyed(): each row's runs (start, words, source, source_start)
    of WINDOW words or more that start earlier in the corpus, source being an id.

    A run is the context of an anchor (all windows around it) or a single window; every window that repeats an earlier one
    lies in some run. Of each join by an anchor, a context or a window, the side with one row a key is written first, so
    that Spark can split the rows of a very common one among tasks.
    """
    docs = documents.select("text", *KEY)
    kinds = "id long, t1 long, t2 long, at int"
    with X.passing_tables(documents.sparkSession) as table:
        repeated = table(docs.mapInArrow(_anchors(False), "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
        places = docs.mapInArrow(_anchors(True), f"anchor long, context long, {kinds}")
        places = table(places.join(repeated.hint("merge"), "anchor"), "anchors")
        here = F.struct(*KEY, "at")
        first = table(places.groupBy("anchor", "context").agg(F.min(here).alias("source"), F.count("*").alias("n")), "index")
        mixed = first.groupBy("anchor").agg(F.min("context").alias("x"), F.max("context").alias("y")).where("x <> y").select("anchor")
        tagged = places.join(first.where("n > 1").select("anchor", "context", "source"), ["anchor", "context"])
        again = tagged.where(F.col("source") != here)
        # the context may be cut by its document's start: the run begins at most ROLL - 1 words before the anchor
        back = F.least("at", F.lit(ROLL - 1))
        by_anchor = again.select(*KEY, (F.col("at") - back).alias("start"), (back + WINDOW).alias("words"), F.col("source.id").alias("source"), (F.col("source.at") - back).alias("source_start"))
        open_ = first.join(table(mixed, "mixed"), "anchor").select("source.*").groupBy(*KEY).agg(F.array_sort(F.collect_set("at")).alias("places"))
        windows = table(docs.join(table(open_, "open"), KEY).mapInArrow(_windows, f"one long, two long, {kinds}"), "windows")
        index = table(windows.groupBy("one", "two").agg(F.min(here).alias("source"), F.count("*").alias("n")).where("n > 1").drop("n"), "window_index")
        by_window = windows.join(index, ["one", "two"]).where(F.col("source") != here)
        by_window = by_window.select(*KEY, F.col("at").alias("start"), F.lit(WINDOW).alias("words"), F.col("source.id").alias("source"), F.col("source.at").alias("source_start"))
        runs = by_anchor.unionAll(by_window).groupBy(*KEY)
        return X.table(runs.agg(F.collect_set(F.struct("start", "words", "source", "source_start")).cast(RUNS).alias("runs")), "runs")


def greedy(runs: list[tuple[int, int, int, int]], total: int) -> list[tuple[int, int, int, int]]:
    """Relative Lempel-Ziv factors (start, words, source, source_start) of one document from its runs, left to right.

    At each place the factor that reaches farthest is taken and grown over runs that continue it in the same source;
    the next factor starts where it ends, or at the next run."""
    out: list[tuple[int, int, int, int]] = []
    runs = sorted((a, min(n, total - a), s, b) for a, n, s, b in runs)
    k, pos = 0, 0
    while k < len(runs):
        if runs[k][0] + runs[k][1] <= pos:
            k += 1
            continue
        pos = max(pos, runs[k][0])
        best, m = None, k
        while m < len(runs) and runs[m][0] <= pos:
            if best is None or runs[m][0] + runs[m][1] > best[0] + best[1]:
                best = runs[m]
            m += 1
        a, n, s, b = best
        while m < len(runs) and runs[m][0] <= a + n:
            if runs[m][2] == s and runs[m][3] - runs[m][0] == b - a:
                n = max(n, runs[m][0] + runs[m][1] - a)
            m += 1
        out.append((pos, a + n - pos, s, b + pos - a))
        pos, k = a + n, k
    return out


def factored(documents: DataFrame, function, schema: str) -> DataFrame:
    """function over batches of (doc_id, text, runs) of every row of documents(doc_id, text)."""
    docs = keyed(documents)
    return docs.join(duplicate_runs(docs), KEY, "left").select("doc_id", "text", "runs").mapInArrow(function, schema)


def _factors(batches):
    for batch in X.parts(batches):
        docs, runs = batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist()
        rows = []
        for i, j, at, data in X.slabs(batch.column("text")):
            _, first, _, _ = X.words(at, data, lower=False)
            for r in range(i, j):
                rows += [(docs[r], *f) for f in greedy([tuple(x.values()) for x in runs[r] or ()], int(first[r - i + 1] - first[r - i]))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "words", "source_doc", "source_start"])


def factors(documents: DataFrame) -> DataFrame:
    """(doc_id, start, words, source_doc, source_start): the duplicate spans of documents(doc_id, text).

    The corpus is its own reference. Its index blocks, dealt by hash, hold each anchor context's first place; anchors
    are chosen by content alone, so equal windows choose equal anchors. Every document is factored against all blocks by
    joins: an anchor whose whole context starts earlier gives a run at once; only at places where runs end, where an
    anchor occurs in several contexts, are single windows looked up, by 128 bits of hash. Earlier means a smaller
    doc_id, or the same and an earlier start. Null text has no words; a null doc_id sorts first (source null, too). Different
    texts under one id, or without an id, are different documents, in the order of a hash of their texts; identical rows
    (same id or none, and same text) are one document, whose factors each of them gets. Under WINDOW words nothing
    repeats; an empty table gives an empty result.
    """
    out = factored(documents, _factors, "doc_id long, start long, words long, source_doc long, source_start long")
    return out.withColumn("source_doc", F.when(F.col("source_doc") != NO_ID, F.col("source_doc")))


def _kept(batches):
    for batch in X.parts(batches):
        runs = batch.column("runs").to_pylist()
        many, gone, sha = [], [], []
        for i, j, at, data in X.slabs(batch.column("text")):
            _, first, starts, ends = X.words(at, data, lower=False)
            raw = data.tobytes()
            for r in range(i, j):
                a, b = int(first[r - i]), int(first[r - i + 1])
                keep = np.ones(b - a, bool)
                for start, words, _, _ in greedy([tuple(x.values()) for x in runs[r] or ()], b - a):
                    keep[start : start + words] = False
                s, e = starts[a:b][keep].tolist(), ends[a:b][keep].tolist()
                many.append(b - a)
                gone.append(b - a - len(s))
                sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s, e)])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(many, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return factored(documents, _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The same rows from every window of the corpus.
OP7_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 18)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM v) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, UNNEST(range(i, i + 20)) AS i FROM d),
x AS (SELECT doc_id, UNNEST(range(1, len(w) + 1)) AS i, UNNEST(w) AS word FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY 1),
g AS (SELECT doc_id, COUNT(*) AS n FROM c GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(g.n, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""
