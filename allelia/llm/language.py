"""Language identification with a bit-sliced Bloom filter of n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X

#: Bytes of an n-gram; documents of a language in the fitting sample; n-grams kept for a language; slots and hashes.
N, DOCS, GRAMS, SLOTS, HASHES = 4, 2_000, 40_000, 1 << 21, 3
#: A language holds an n-gram that it has at least this share as often as the language that has it most.
SHARE = 0.25
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[i for i in range(128) if not chr(i).isalpha()]] = 32


def grams(data: np.ndarray) -> np.ndarray:
    """The N-byte windows as integers: A-Z in lower case, other ASCII than letters as a space."""
    b = _CLASS[data].astype(np.uint32)
    if len(b) < N:
        return np.zeros(0, np.uint32)
    out = b[: len(b) - N + 1].copy()
    for k in range(1, N):
        out = (out << np.uint32(8)) | b[k : len(b) - N + 1 + k]
    return out


def _useful(g: np.ndarray) -> np.ndarray:
    """Not an n-gram with two spaces side by side."""
    pair = np.zeros(len(g), bool)
    for k in range(0, 8 * (N - 1), 8):
        pair |= (g >> np.uint32(k)) & np.uint32(0xFFFF) == np.uint32(0x2020)
    return ~pair


def rows_of(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, row of each) of a slab; none spans two rows."""
    g = grams(data)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[: len(g)]
    ok = _useful(g)
    if len(g):
        ok &= np.repeat(at[1:], np.diff(at))[: len(g)] - np.arange(len(g)) >= N
    return g[ok], row[ok]


def _count(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for i, j, at, data in X.slabs(batch.column("text")):
            g, row = rows_of(at, data)
            for lang in sorted(set(langs[i:j])):
                own, n = np.unique(g[(langs[i:j] == lang)[row]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


class Filter:
    """Slots of one bit per language. An n-gram sets its language's bit in HASHES slots; the AND of these slots' words
    is the set of all languages that hold it."""

    def __init__(self, langs: list[str], slots: int = SLOTS):
        self.langs, self.words = langs, max(1, -(-len(langs) // 64))
        self.bits = np.zeros((self.words, slots), np.uint64)

    def _slots(self, g: np.ndarray):
        h = X.mix(g.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((h + np.uint64(k) * step) & np.uint64(self.bits.shape[1] - 1)).astype(np.int64)

    def add(self, g: np.ndarray, lang: int) -> None:
        for at in self._slots(g):
            np.bitwise_or.at(self.bits[lang // 64], at, np.uint64(1 << (lang % 64)))

    def seal(self) -> Filter:
        """Know each language's rate of false positives: its share of set bits to the power of HASHES."""
        share = [np.count_nonzero(self.bits[k // 64] & np.uint64(1 << (k % 64))) / self.bits.shape[1] for k in range(len(self.langs))]
        self.false = np.array(share) ** HASHES
        return self

    def masks(self, g: np.ndarray) -> np.ndarray:
        out = np.full((self.words, len(g)), ~np.uint64(0))
        for at in self._slots(g):
            for w in range(self.words):
                out[w] &= self.bits[w][at]
        return out

    def decide(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language's place or -1, score) of each row."""
        g, row = rows_of(at, data)
        n = np.bincount(row, minlength=len(at) - 1)
        mask = self.masks(g)
        found = np.empty((len(self.langs), len(at) - 1))
        for k in range(len(self.langs)):
            hit = (mask[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            found[k] = np.bincount(row, hit, minlength=len(at) - 1)
        found = np.maximum(0, (found - n * self.false[:, None]) / (1 - self.false[:, None]))
        total = found.sum(0)
        best = found.argmax(0)
        score = np.divide(found.max(0), total, out=np.zeros(len(n)), where=total > 0)
        return np.where(total > 0, best, -1), score


def train(documents: DataFrame, usable=None) -> tuple[Filter, str]:
    """A filter from documents(doc_id, text, lang) that meet usable, and the language of most of them.

    The sample is bounded: DOCS documents a language, drawn by a hash of doc_id. Rows with a null id, text or lang
    take no part; ties go to the language that sorts first."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if usable is None else usable))
    sizes = sorted((r.lang, r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return Filter([], 64).seal(), "und"
    rate = F.create_map(*[F.lit(x) for k, n in sizes for x in (k, min(1.0, DOCS / n))])
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    counts = known.where(uniform < rate[F.col("lang")]).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 3")
    counts = counts.withColumn("r", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    counts = counts.withColumn("top", F.max("r").over(Window.partitionBy("gram"))).where(F.col("r") >= SHARE * F.col("top"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    with X.small_batches(documents.sparkSession):
        rows = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= GRAMS).select("lang", "gram").toPandas()
    out = Filter([k for k, _ in sizes])
    for k, (lang, _) in enumerate(sizes):
        out.add(rows["gram"][rows["lang"] == lang].to_numpy(np.uint32), k)
    return out.seal(), min(sizes, key=lambda x: (-x[1], x[0]))[0]


def predict(documents: DataFrame, model: Filter, default: str) -> DataFrame:
    """(doc_id, lang_pred, score) of documents(doc_id, text): `und` with score 0 if text is null or has no letter.

    A text with letters but without a known n-gram gets the default language with score 0; equal counts go to the
    language that sorts first. Whole texts decide."""
    held = documents.sparkSession.sparkContext.broadcast((model, default))

    def make(batches):
        model, default = held.value
        names = np.array([*model.langs, default], object)
        for batch in X.parts(batches):
            letter = np.array(batch.column("letter").to_pylist(), bool)
            for i, j, at, data in X.slabs(batch.column("text")):
                k, s = model.decide(at, data) if model.langs else (np.full(j - i, -1), np.zeros(j - i))
                pred = np.where(letter[i:j], names[k], "und")
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(np.where(letter[i:j], s, 0.0))], names=["doc_id", "lang_pred", "score"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    return documents.select("doc_id", "text", letter).mapInArrow(make, "doc_id long, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(documents, *train(documents, ~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
