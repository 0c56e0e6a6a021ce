"""Benchmark decontamination: SimHash windows of each item's size, a multi-index Hamming probe, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X

#: 64-bit blocks of a fingerprint, and errors that a block may have: a window within RADIUS bits of an item has a block with
#: at most ERRORS unequal bits, as BLOCKS * (ERRORS + 1) > RADIUS. Of unrelated windows one in 320 has such a block (binomial;
#: a test counts them). Two windows that share 0.8 of their shingles differ in 52 of 256 bits on average (standard deviation
#: 6.5), so 79 leaves out one in 28,000 of those at the limit.
BLOCKS, ERRORS = 4, 19
RADIUS = 79
#: Items that one pass holds in memory; more items take more passes, over documents that a bitmap of all items leaves.
ITEMS = 5_000
#: Windows of a document that are fingerprinted at once; windows times items that are compared at once.
CHUNK, PAIRS = 4_096, 1 << 20
#: Bits of the bitmap of all items' shingles.
BITMAP = 1 << 28
_WORDS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)]


def _signs(s: np.ndarray) -> np.ndarray:
    """(shingles, bits) of -1 or 1."""
    raw = np.stack([X.mix(s ^ w) for w in _WORDS], 1)
    return np.unpackbits(raw.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def blocks_of(signs: np.ndarray) -> np.ndarray:
    """(rows, BLOCKS) 64-bit blocks of fingerprints from sums of signs."""
    return np.packbits(signs > 0, axis=1).view(np.uint64)


def candidates(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs of blocks that the index returns: one block with at most ERRORS unequal bits."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, PAIRS // max(1, len(items)))
    for k in range(0, len(windows), step):
        part = windows[k : k + step]
        close = np.zeros((len(part), len(items)), bool)
        for b in range(BLOCKS):
            close |= np.bitwise_count(part[:, b, None] ^ items[None, :, b]) <= ERRORS
        w, i = np.nonzero(close)
        out.append((w + k, i))
    return tuple(np.concatenate(x) for x in zip(*out))


class Items:
    """Benchmark items by size: shingles with weights (their counts) and the blocks of their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], n: int = 5):
        self.n, self.ids, self.sizes, self.sets = n, [], [], []
        prints = []
        for item, text in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
            for _, _, at, data in X.slabs(pa.array([text or ""], pa.string())):
                h, first, _, _ = X.words(at, data, lower=True)
                s, _, _ = X.shingles(h, first, n)
                if len(h) >= n:
                    self.ids.append(item)
                    self.sizes.append(len(h))
                    self.sets.append(np.unique(s, return_counts=True))
                    prints.append(_signs(s).sum(0, dtype=np.int32))
        self.blocks = blocks_of(np.array(prints, np.int32)) if prints else np.zeros((0, BLOCKS), np.uint64)
        self.all = np.unique(np.concatenate([s for s, _ in self.sets])) if self.sets else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.all & np.uint64((1 << 22) - 1)] = True
        self.by_size = {m: np.flatnonzero(np.array(self.sizes) == m) for m in sorted(set(self.sizes))}

    def known(self, s: np.ndarray) -> np.ndarray:
        """Which shingles any item has."""
        out = self.maybe[s & np.uint64((1 << 22) - 1)]
        k = np.flatnonzero(out)
        if len(k):
            at = np.searchsorted(self.all, s[k])
            at[at == len(self.all)] = 0
            out[k] = self.all[at] == s[k]
        return out

    def matches(self, s: np.ndarray, known: np.ndarray, least: float):
        """(item, window's first word, similarity) for windows of a document whose shingles are s in order. A document
        that is shorter than an item is one window."""
        hits = np.append(0, np.cumsum(known))
        lo, hi = int(np.argmax(known)), len(known) - int(np.argmax(known[::-1]))
        for m, own in self.by_size.items():
            w = m - self.n + 1
            width = min(w, len(s))
            if width < least * w - 1e-9:
                break  # larger items need still more
            # a window that is similar enough holds so many shingles of items
            first = np.arange(max(0, lo - width + 1), min(len(s) - width + 1, hi))
            first = first[hits[first + width] - hits[first] >= least * w - 1e-9]
            if not len(first):
                continue
            for part in np.split(first, np.flatnonzero(np.diff(first // CHUNK)) + 1):
                yield from self._probe(s, part, width, w, own, least)

    def _probe(self, s: np.ndarray, first: np.ndarray, width: int, w: int, own: np.ndarray, least: float):
        signs = np.zeros((first[-1] + width - first[0] + 1, 64 * BLOCKS), np.int32)
        np.cumsum(_signs(s[first[0] : first[-1] + width]), axis=0, out=signs[1:])
        windows = blocks_of(signs[first - first[0] + width] - signs[first - first[0]])
        at, item = candidates(windows, self.blocks[own])
        near = np.bitwise_count(windows[at] ^ self.blocks[own[item]]).sum(1) <= RADIUS
        for k, i in zip(first[at[near]].tolist(), own[item[near]].tolist()):
            a, ca = self.sets[i]
            b, cb = np.unique(s[k : k + width], return_counts=True)
            _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            same = np.minimum(ca[x], cb[y]).sum() / w
            if same >= least - 1e-12:
                yield self.ids[i], k, float(same)


def _scan(held, least: float):
    def make(batches):
        items = held.value
        for batch in X.parts(batches):
            out: dict[tuple, tuple] = {}
            for i, j, at, data in X.slabs(batch.column("text")):
                h, first, _, _ = X.words(at, data, lower=True)
                s, row, _ = X.shingles(h, first, items.n)
                known = items.known(s)
                bounds = np.searchsorted(row, np.arange(j - i + 1))
                many = np.bincount(row[known], minlength=j - i)
                for r in np.flatnonzero(many >= max(1, least * (min(items.by_size, default=0) - items.n + 1) - 1e-9)):
                    own = slice(bounds[r], bounds[r + 1])
                    for item, start, same in items.matches(s[own], known[own], least):
                        key = (i + int(r), item)
                        if key not in out or (-same, start) < (-out[key][1], out[key][0]):
                            out[key] = (start, same)
            rows = sorted(out)
            at = pa.array([r for r, _ in rows], pa.int64())
            found = [pa.array([x for _, x in rows], pa.int64()), pa.array([out[x][0] for x in rows], pa.int64()), pa.array([out[x][1] for x in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), *found], names=["row", "item_id", "start_word", "similarity"])

    return make


def _survivors(held):
    """Rows with a shingle that the bitmap holds."""

    def make(batches):
        bits = held.value
        for batch in X.parts(batches):
            keep = np.zeros(batch.num_rows, bool)
            for i, j, at, data in X.slabs(batch.column("text")):
                h, first, _, _ = X.words(at, data, lower=True)
                s, row, _ = X.shingles(h, first)
                k = s & np.uint64(BITMAP - 1)
                keep[i:j] = np.bincount(row, (bits[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8)) & 1, minlength=j - i) > 0
            yield batch.filter(pa.array(keep))

    return make


def contaminated_rows(documents: DataFrame, benchmark: DataFrame, least: float = 0.8, per_pass: int = ITEMS) -> DataFrame:
    """(row, item_id, start_word, similarity), row being text.row_key(); see contaminated()."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    count = max(1, -(-items.count() // per_pass))
    # about per_pass items each
    passes = [items.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k) for k in range(count)]
    rows = lambda k: [(r.item_id, r.text) for r in passes[k].collect()]
    docs = documents.select(X.row_key().alias("row"), "text")
    if count > 1:
        bits = np.zeros(BITMAP // 8, np.uint8)
        for k in range(count):
            h = Items(rows(k)).all & np.uint64(BITMAP - 1)
            np.bitwise_or.at(bits, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        docs = X.table(docs.mapInArrow(_survivors(spark.sparkContext.broadcast(bits)), docs.schema), "survivors")
    out = None
    for k in range(count):
        held = spark.sparkContext.broadcast(Items(rows(k)))
        found = docs.mapInArrow(_scan(held, least), "row struct<doc_id: bigint, t1: bigint, t2: bigint>, item_id long, start_word long, similarity double")
        out = found if out is None else out.unionAll(found)
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, least: float = 0.8, per_pass: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, start_word, similarity): the best window of each document row for each benchmark item it leaks.

    Words are lower-cased (A-Z). A window has as many words as the item; similarity is the weighted share of 5-word
    shingles in common, sum of min(weights) over the item's weight (for equal sizes the Dice coefficient), weights
    being counts. A document that is shorter than the item is one window. Windows that can't reach the limit, as they
    hold too few shingles of any item, are left out without loss; the rest are fingerprinted, and the multi-index returns
    every item within RADIUS bits (which leaves out one in 28,000 of the windows at the limit, fewer above it), which the
    exact similarity then confirms. Ties go to the first window. Items under 5 words, null or empty texts and null item
    ids match nothing; a null doc_id stays null; rows that repeat an id are each judged by their text; empty tables give an
    empty result. The items of a pass (per_pass at most) are broadcast; more items are taken by ranges of item_id, so
    memory stays bounded, and the later passes read only documents that share a shingle with some item.
    """
    return contaminated_rows(documents, benchmark, least, per_pass).select(F.col("row.doc_id").alias("doc_id"), "item_id", "start_word", "similarity")


def without_leaks(documents: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of documents that leak no item; a row is judged by its own text, whatever others share its id or lack one."""
    return X.without(documents, contaminated_rows(documents, benchmark, least))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same rows from every window that shares a shingle with an item.
OP9_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
i AS (SELECT item_id, s, COUNT(*) AS c FROM (SELECT item_id, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT item_id, w, UNNEST(range(0, len(w) - 4)) AS p FROM v WHERE len(w) > 4)) GROUP BY 1, 2),
m AS (SELECT item_id, len(w) - 4 AS w FROM v WHERE len(w) > 4),
d AS (SELECT doc_id, p, n, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT doc_id, w, len(w) - 4 AS n, UNNEST(range(0, len(w) - 4)) AS p FROM w WHERE len(w) > 4)),
h AS (SELECT doc_id, item_id, n, m.w, p, s, c FROM d JOIN i USING (s) JOIN m USING (item_id)),
k AS (SELECT doc_id, item_id, w, s, c, UNNEST(range(GREATEST(0, p - w + 1), LEAST(p, n - w) + 1)) AS k FROM h WHERE n >= w UNION ALL SELECT doc_id, item_id, w, s, c, 0 FROM h WHERE n < w),
o AS (SELECT doc_id, item_id, w, k, LEAST(COUNT(*), c) AS c FROM k GROUP BY doc_id, item_id, w, k, s, k.c),
t AS (SELECT doc_id, item_id, k, CAST(SUM(c) AS DOUBLE) / w AS similarity FROM o GROUP BY doc_id, item_id, w, k)
SELECT doc_id, item_id, k AS start_word, similarity FROM t WHERE similarity >= 0.8 - 1e-12 QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, k) = 1
"""
