"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X

#: Bounds of the fitting sample: confirmed toxic documents, documents of any kind as unlabelled text.
TOXIC_DOCS, OTHER_DOCS = 6_000, 14_000
#: Documents of the sample that must hold a feature.
LEAST_DOCS = 4
#: Standard deviations by which a feature's share of toxic documents must differ from its share of unlabelled ones.
APART = 4.0
#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
STEPS, RATE, RIDGE = 400, 0.05, 1e-5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of a slab's words, lower-cased and split at all ASCII but letters, and of their beginnings; with repeats."""
    h, first, starts, ends = X.words(at, data, lower=True, letters=True)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    out, rows = [h], [row]
    size = ends - starts
    code = np.zeros(len(h), np.uint64)
    low = np.append(_LOWER[data], np.zeros(max(BEGINNINGS), np.uint8))
    for k in range(max(BEGINNINGS)):
        code = code << np.uint64(8) | low[starts + k]
        if k + 1 in BEGINNINGS:
            own = size > k + 1
            out.append(X.mix(code[own] + np.uint64((k + 1) << 60)))
            rows.append(row[own])
    return np.concatenate(out), np.concatenate(rows)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) without repeats, by row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _tally(batches):
    """By batch and feature: the documents, and the toxic ones, that hold it."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, j, at, data in X.slabs(batch.column("text")):
            h, row = _distinct(*features(at, data))
            names, k, n = np.unique(h, return_inverse=True, return_counts=True)
            t = np.bincount(k, toxic[i:j][row], minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(X.signed(names)), pa.array(n, pa.int64()), pa.array(t)], names=["h", "n", "t"])


def _held(names: np.ndarray):
    """Each document's features that names, sorted, has: their places as bytes."""

    def make(batches):
        model = Model(names, np.zeros(len(names)), 0.0)
        for batch in batches:
            for i, j, at, data in X.slabs(batch.column("text")):
                row, k = model.places(at, data)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                blobs = [k[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, j - i), pa.array(blobs, pa.binary())], names=["toxic", "places"])

    return make


class Model:
    """A linear model over the presence of features; names holds their hashes, sorted."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias
        self.seen = np.zeros(1 << 20, bool)
        self.seen[names & np.uint64((1 << 20) - 1)] = True

    def places(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in names) of each row's distinct features, by row."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, row = features(at, data)
        maybe = self.seen[h & np.uint64((1 << 20) - 1)]
        h, row = h[maybe], row[maybe]
        k = np.searchsorted(self.names, h)
        k[k == len(self.names)] = 0
        hit = self.names[k] == h
        pair = np.unique(row[hit] * np.int64(len(self.names)) + k[hit])
        return pair // len(self.names), pair % len(self.names)

    def scores(self, at: np.ndarray, data: np.ndarray) -> np.ndarray:
        row, k = self.places(at, data)
        z = self.bias + np.bincount(row, self.weights[k], minlength=len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(names: np.ndarray, toxic: list[np.ndarray], other: list[np.ndarray], prior: float) -> Model:
    """Minimise prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]) with the logistic loss, by Adam.

    toxic and other hold the places in names of each document's features. Where the bracket is negative it counts as 0
    and so does its gradient: the corrected risk of the negatives gains nothing from falling below 0.
    """
    if not toxic or not other:
        return Model(names[:0], np.zeros(0), -500.0)
    row = np.repeat(np.arange(len(toxic) + len(other)), [len(x) for x in (*toxic, *other)])
    k = np.concatenate([*toxic, *other]).astype(np.int64)
    n, w, b = len(toxic) + len(other), np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    p = np.arange(n) < len(toxic)
    for t in range(1, STEPS + 1):
        z = b + np.bincount(row, w[k], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        rest = np.logaddexp(0, z[~p]).mean() - prior * np.logaddexp(0, z[p]).mean()
        up = np.where(p, -prior * s / p.sum(), s / (~p).sum())  # the bracket's gradient by z
        g = np.where(p, -prior * (1 - s) / p.sum(), 0) + (up if rest >= 0 else 0)
        grad = np.append(np.bincount(k, g[row], minlength=len(w)) + RIDGE * w, g.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        step = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    # the corrected risk says little of where between the classes 0 lies: the mean score of unlabelled text is the prior
    z = (b + np.bincount(row, w[k], minlength=n))[~p]
    low, high = -60.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        mean = (1 / (1 + np.exp(-np.clip(z + middle, -500, 500)))).mean()
        low, high = (middle, high) if mean < prior else (low, middle)
    return Model(names, w, b + low)


def train(documents: DataFrame, labels: DataFrame, usable=None) -> Model:
    """Fit on documents(doc_id, text) and labels(doc_id, toxic) whose doc_id meets the condition usable.

    The sample has at most TOXIC_DOCS and OTHER_DOCS rows, drawn by a hash of doc_id and, where ids repeat, then by one of id and
    text, identical rows counting once; whole texts give the features. The class prior is the share of toxic labels. Features are the words and beginnings whose shares of toxic and of unlabelled
    documents differ by APART standard deviations, so that long texts don't add up noise. Null labels and null ids take no part; without a toxic example every
    score is 0.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", "toxic")
    count = known.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    prior = min(0.95, max(1e-4, (count.p or 0) / max(1, count.n)))
    draw = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = draw(known.where("toxic = 1"), TOXIC_DOCS).withColumn("toxic", F.lit(1))
    picked = picked.unionAll(draw(documents.where(F.col("doc_id").isNotNull() & usable), OTHER_DOCS).withColumn("toxic", F.lit(0)))
    # at most TOXIC_DOCS + OTHER_DOCS ids
    sample = X.table(documents.select("doc_id", "text", X.row_key().alias("row")).join(F.broadcast(picked), "doc_id").select("toxic", "text", "row"), "sample")
    size = sample.agg(F.count("*").alias("n"), F.count_distinct("toxic", "row").alias("rows")).first()
    if size.n > picked.count() or size.rows < size.n:  # ids with several rows: again at most as many rows
        each = sample.dropDuplicates(["toxic", "row"])
        first = lambda toxic, n: each.where(F.col("toxic") == toxic).select("toxic", "row").orderBy(F.xxhash64("row"), "row").limit(n)
        some = X.table(first(1, TOXIC_DOCS).unionAll(first(0, OTHER_DOCS)), "drawn")
        sample = X.table(each.join(F.broadcast(some), ["toxic", "row"], "left_semi"), "sample")
    n = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    p, u = float(n.p or 0), float(n.n - (n.p or 0))
    if not p or not u:
        return fit(np.zeros(0, np.uint64), [], [], prior)
    tally = sample.mapInArrow(_tally, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    share = F.col("n") / (p + u)
    apart = F.abs(F.col("t") / p - (F.col("n") - F.col("t")) / u) >= APART * F.sqrt(share * (1 - share) * (1 / p + 1 / u))
    with X.small_batches(documents.sparkSession):
        chosen = tally.where((F.col("n") >= min(LEAST_DOCS, p)) & (share < 1) & apart).select("h").toPandas()
        names = np.sort(chosen["h"].to_numpy(np.int64).view(np.uint64))
        rows = sample.mapInArrow(_held(names), "toxic int, places binary").collect()
    sets = [(r.toxic, np.frombuffer(r.places, np.int32)) for r in rows]
    return fit(names, [x for t, x in sets if t], [x for t, x in sets if not t], prior)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents(doc_id, text) with score (0 to 1) and predicted (1 from 0.5 on); null or empty text has the bias alone."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        for batch in batches:
            for i, j, at, data in X.slabs(batch.column("text")):
                s = held.value.scores(at, data)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(make, "doc_id long, score double, predicted int")


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of documents, whole, that score below 0.5. Null and empty texts score as the bias does, under 0.5 unless most
    unlabelled text is toxic; repeated rows and rows without an id are each judged by their text."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def make(batches):
        for batch in X.parts(batches):
            good = [held.value.scores(at, data) < 0.5 for _, _, at, data in X.slabs(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return documents.mapInArrow(make, documents.schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(documents, train(documents, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
