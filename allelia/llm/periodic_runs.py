"""Periodic runs of words: overlapping tiles per octave of periods, solved one by one, their fragments stitched by document and period."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X
from .manifest import _CRC_TABLE, crc32_sql

#: A run has LEAST words and TIMES periods at least.
LEAST, TIMES = 6, 4
#: Bytes of a text up to which its tiles are solved where it is read; those of longer texts are dealt among tasks.
SPREAD = 1 << 20
#: Words whose tiles are solved together; words of a tile at least; places compared at once; words compared before a tile is solved.
STRIP, WIDE, AT_ONCE, PROBE = 1 << 13, 256, 1 << 20, 32
FRAGMENT = "struct<q: int, s: int, e: int>"
RUNS = "array<struct<start: long, length: long, period: long>>"


def z_values(x: list) -> list[int]:
    """The Z-function: of each place, how many items from there on equal those from the first on."""
    n = len(x)
    z = [n] * min(n, 1) + [0] * (n - 1)
    a = b = 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def sure(size: int) -> int:
    """Words that repeat for certain from the first boundary in a run on: of its places that equal those a period further on,
    3 * size at least, the boundary leaves size - 1 behind."""
    return max(LEAST, TIMES * size) - 2 * size + 1


def reach(size: int) -> int:
    """Words of a tile from its boundary on: any run's part up to the next boundary that its own part doesn't cover, or WIDE."""
    return max(sure(size) + 3 * size - 1, WIDE)


def candidates(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, periods), in order, of the octave of periods from size up to twice that: the tile boundaries (every size
    words of a row) from which on the words repeat after such a period, for sure(size) words or PROBE."""
    n = np.diff(first)
    rows = np.flatnonzero(n >= max(LEAST, TIMES * size))
    count = n[rows] // size
    begin = np.repeat(first[rows], count) + size * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    end, most = np.repeat(first[rows + 1], count), np.repeat(n[rows] // TIMES, count)
    q, found = np.arange(size, 2 * size), [(begin[:0], begin[:0])]
    for k in range(0, len(begin), max(1, AT_ONCE // size)):
        b, e, m = (v[k : k + max(1, AT_ONCE // size), None] for v in (begin, end, most))
        there = b + q
        same = (there + sure(size) <= e) & (q <= m) & (h[b] == h[np.minimum(there, len(h) - 1)])
        i, j = np.nonzero(same)
        i, j = b[i, 0], q[j]
        for t in range(1, min(sure(size), PROBE)):
            if not len(i):
                break
            ok = h[i + t] == h[i + j + t]
            i, j = i[ok], j[ok]
        found.append((i, j))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def solve(words: list, at: int, size: int, most: int) -> tuple[list, list]:
    """(parts, others) of a tile. parts (q, s, e): of periods q from size up to twice that (most at most), the places [s, e) around
    the boundary `at` at which words equal those q further on; only where sure(size) words from the boundary on do, and where
    no smaller period explains the same stretch. others (p, s, end): the stretches of smaller periods that do.

    The Z-function of the words from the boundary on gives how far each period reaches to the right, that of the reversed
    words how far to the left. A stretch with two periods that is as long as their sum has their greatest common divisor as
    a period, so a period that is a multiple of a run's own, then under size, is known from the tile alone."""
    right = np.array(z_values(words[at : at + reach(size)]), np.int64)
    end = min(at + 2 * size, len(words))
    top = min(2 * size, len(right), end - at + 1)  # periods are below
    back = words[max(0, at - size) : at][::-1]
    z = np.array(z_values([*back, None, *words[max(0, at - size) : end][::-1]]), np.int64)
    shift = np.arange(top)
    left = z[np.minimum(len(back) + 1 + end - at - shift, len(z) - 1)]
    right, ends = right[:top], shift + right[:top]
    open_, parts, others = shift[size : most + 1][right[size : most + 1] >= sure(size)], [], []
    while len(open_):
        q = open_[0]
        covers = np.flatnonzero((left[1:size] >= left[q]) & (ends[1:size] >= ends[q]))
        if len(covers):
            p = covers[0] + 1
            open_ = open_[(left[open_] > left[p]) | (ends[open_] > ends[p])]
            others.append((int(p), int(at - left[p]), int(at + ends[p])))
        else:
            parts.append((int(q), int(at - left[q]), int(at + right[q])))
            open_ = open_[1:]
    return parts, others


def solve_strip(x: np.ndarray, at: np.ndarray, q: np.ndarray, size: int, most: int) -> list[tuple[int, int, int]]:
    """(q, s, e) in the words x from the tiles at candidates (at, q), in order; those that an earlier tile explains are skipped."""
    out = []
    while len(at):
        b = int(at[0])
        lo = max(0, b - size)
        parts, others = solve(x[lo : b + reach(size)].tolist(), b - lo, size, most)
        done = at == b
        for p, s, e in parts:
            out.append((p, s + lo, e + lo))
            # where the tile's end cuts the part, the next candidate may be the last of its run
            cut = size - 1 if e + p >= b - lo + reach(size) else 0
            done |= (q == p) & (at >= s + lo) & (at + sure(size) + cut <= e + lo)
        for _, s, end in others:
            done |= (at >= s + lo) & (at + q + sure(size) <= end + lo)
        at, q = at[~done], q[~done]
    return joined(out)


def joined(fragments: list[tuple]) -> list[tuple]:
    """(..., s, e) with those of equal beginning put together where they overlap or touch."""
    out: list[tuple] = []
    for f in sorted(fragments):
        if out and out[-1][:-2] == f[:-2] and f[-2] <= out[-1][-1]:
            out[-1] = (*out[-1][:-1], max(out[-1][-1], f[-1]))
        else:
            out.append(f)
    return out


def octaves(first: np.ndarray):
    size = 1
    while len(first) > 1 and max(LEAST, TIMES * size) <= np.diff(first).max():
        yield size
        size *= 2


def strips(h: np.ndarray, first: np.ndarray, size: int, known: np.ndarray | None = None):
    """(row, first word, end word, boundaries from the first word, periods) of STRIP words' candidates together; not of those
    within a known stretch of a smaller period. known: to where such a stretch reaches that starts at a word or before."""
    at, q = candidates(h, first, size)
    if known is not None:
        new = known[at] < at + q + sure(size)
        at, q = at[new], q[new]
    row = np.searchsorted(first, at, "right") - 1
    place = (at - first[row]) // STRIP
    for k in np.split(np.arange(len(at)), np.flatnonzero((row[1:] != row[:-1]) | (place[1:] != place[:-1])) + 1):
        if len(k):
            r = int(row[k[0]])
            lo, hi = max(int(first[r]), int(at[k[0]]) - size), min(int(first[r + 1]), int(at[k[-1]]) + reach(size))
            yield r, lo, hi, at[k] - lo, q[k]


def fragments(h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, q, s, e) of a slab's whole rows that are long enough for a run, places from 0 in each row."""
    out: list[tuple] = []
    known = np.zeros(len(h), np.int64)
    for size in octaves(first):
        found = []
        for r, lo, hi, at, q in strips(h, first, size, known):
            shift = lo - int(first[r])
            found += [(r, p, s + shift, e + shift) for p, s, e in solve_strip(h[lo:hi], at, q, size, int(first[r + 1] - first[r]) // TIMES)]
        for r, p, s, e in joined(found):
            known[first[r] + s] = max(known[first[r] + s], first[r] + e + p)
        if found:
            known = np.maximum.accumulate(known)
        out += found
    return [f for f in joined(out) if f[3] - f[2] + f[1] >= max(LEAST, TIMES * f[1])]


def _text(starts, ends, data, first, keep) -> pa.Array:
    """The kept words of each row, joined by one space."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
    starts, lens = starts[keep], (ends - starts)[keep]
    gap = np.append(False, row[1:] == row[:-1])[: len(row)].astype(np.int64)
    place = np.cumsum(lens + gap) - lens
    flat = np.full(int((lens + gap).sum()), 32, np.uint8)
    inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    flat[np.repeat(place, lens) + inside] = data[np.repeat(starts, lens) + inside]
    offsets = np.append(0, np.cumsum(np.bincount(row, lens + gap, len(first) - 1).astype(np.int64)))
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets), pa.py_buffer(flat)).cast(pa.string())


def _held(batches):
    """Of texts with fragments: the row, the text and the fragments."""
    for batch in batches:
        for i, j, at, data in X.slabs(batch.column("text")):
            h, first, _, _ = X.words(at, data, lower=False)
            found = fragments(h, first)
            if found:
                own: dict[int, list] = {}
                for r, q, s, e in found:
                    own.setdefault(r, []).append({"q": q, "s": s, "e": e})
                some = pa.array(list(own), pa.int64())
                kind = pa.list_(pa.struct([("q", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i).take(some) for c in ("row", "text")], pa.array(list(own.values()), kind)], names=["row", "text", "fragments"])


def _plain(batches):
    """Of texts without fragments: id, number of words, words joined by one space."""
    for batch in batches:
        for i, j, at, data in X.slabs(batch.column("text")):
            h, first, starts, ends = X.words(at, data, lower=False)
            none = np.ones(j - i, bool)
            none[[f[0] for f in fragments(h, first)]] = False
            text = _text(starts, ends, data, first, np.ones(len(h), bool))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first), pa.int64()), text], names=["doc_id", "n_words", "text"])
            yield out.filter(pa.array(none))


def _strips(batches):
    """Of long texts: the strips that hold candidates, with their words."""
    for batch in batches:
        for i, j, at, data in X.slabs(batch.column("text")):
            h, first, _, _ = X.words(at, data, lower=False)
            for size in octaves(first):
                for r, lo, hi, places, q in strips(h, first, size):
                    n = int(first[r + 1] - first[r])
                    facts = [pa.array([v], pa.int64()) for v in (size, lo - int(first[r]), n // TIMES)]
                    lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (places, q)]
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(i + r, 1), *facts, *lists, pa.array([h[lo:hi].tobytes()], pa.binary())], names=["row", "size", "lo", "most", "at", "q", "words"])


def _solve_strips(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            size, lo, most = (batch.column(c)[k].as_py() for c in ("size", "lo", "most"))
            at, q = (batch.column(c)[k].values.to_numpy() for c in ("at", "q"))
            own = solve_strip(np.frombuffer(batch.column("words")[k].as_buffer(), np.uint64), at, q, size, most)
            if own:
                spans = [pa.array([f[0] for f in own], pa.int32()), *[pa.array([f[c] + lo for f in own], pa.int32()) for c in (1, 2)]]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array([k] * len(own))), *spans], names=["row", "q", "s", "e"])


def _collapse(batches):
    for batch in batches:
        runs = batch.column("runs")
        for i, j, at, data in X.slabs(batch.column("text")):
            h, first, starts, ends = X.words(at, data, lower=False)
            own = runs.slice(i, j - i)
            row = np.repeat(np.arange(j - i), [len(v) if v.is_valid else 0 for v in own])
            start, length, period = (own.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            inside = np.zeros(len(h) + 1, np.int64)
            np.add.at(inside, first[row] + start + period, 1)
            np.add.at(inside, first[row] + start + length, -1)
            text = _text(starts, ends, data, first, np.cumsum(inside)[:-1] == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first), pa.int64()), own, text], names=["doc_id", "n_words", "runs", "text"])


def stitched(found: DataFrame) -> DataFrame:
    """(row, runs) of fragments(row, q, s, e): those of a document and period that overlap or touch are one; runs start, length
    and period in order of start, then period. Rows without a run are absent. A window by document and period puts a
    document's fragments together, which are at most as many as its tiles."""
    found = found.groupBy("row", "q", "s").agg(F.max("e").alias("e"))
    order = Window.partitionBy("row", "q").orderBy("s")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    found = found.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = found.groupBy("row", "q", "island").agg(F.min("s").cast("long").alias("start"), (F.max("e") - F.min("s") + F.col("q")).cast("long").alias("length"))
    whole = whole.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("q")))
    each = F.array_sort(F.collect_list(F.struct("start", F.col("q").cast("long").alias("period"), "length")))
    each = F.transform(each, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    return whole.groupBy("row").agg(each.cast(RUNS).alias("runs"))


def collapsed(documents: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_words, runs, text) of documents(doc_id, text), one row per row: its periodic runs, and its words, joined by one
    space, without those that lie in a run after its first period.

    A run is a stretch of consecutive words whose smallest period q fits in at least TIMES times, of LEAST words or more,
    that no neighbouring word extends keeping it; runs start, length and period count words from 0. Null and empty texts have no words and
    no runs, and give an empty text. Rows that repeat or lack an id are told apart by their texts; identical rows have
    identical results. An empty table gives an empty result.

    For each octave of periods, from Q up to 2 Q, a document is cut into tiles of 6 Q words around boundaries that lie Q
    apart, so that every run has a boundary from which 2 Q + 1 words repeat, and neighbouring tiles overlap. A vectorised
    comparison of all boundaries and periods leaves those tiles in which words repeat; these are solved by themselves, but for
    those that a tile before them in the same strip explains. Tiles of texts over `spread` bytes are dealt among tasks with their words, others are solved where they are read.
    Fragments are shuffled by document and period; texts without any are read twice and never shuffled, the others
    are written once and meet their runs by row.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= spread)
    long = docs.where(F.octet_length("text") > spread).select(X.row_key().alias("row"), "text")
    row = "row struct<doc_id: long, t1: long, t2: long>"
    held = X.table(short.select(X.row_key().alias("row"), "text").mapInArrow(_held, f"{row}, text string, fragments array<{FRAGMENT}>"), "held")
    with X.passing_tables(documents.sparkSession) as table:
        strips = long.mapInArrow(_strips, f"{row}, size long, lo long, most long, at array<long>, q array<long>, words binary")
        strips = strips.repartition("row", "size", "lo")
        found = held.select("row", F.explode("fragments").alias("f")).select("row", "f.*")
        found = table(found.unionAll(strips.mapInArrow(_solve_strips, f"{row}, q int, s int, e int")), "fragments")
        runs = X.table(stitched(found), "runs")
    few = (runs.agg(F.sum(F.size("runs"))).first()[0] or 0) <= X.BROADCAST_KEYS
    texts = held.select("row", "text").unionAll(long)
    kind = "doc_id long, n_words long"
    changed = texts.join(F.broadcast(runs) if few else runs, "row", "left").select("row.doc_id", "text", "runs").mapInArrow(_collapse, f"{kind}, runs {RUNS}, text string")
    plain = short.mapInArrow(_plain, f"{kind}, text string").select("doc_id", "n_words", F.lit(None).cast(RUNS).alias("runs"), "text")
    return plain.unionAll(changed).withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the periodic tail that op11's contract puts into every tenth document or so."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(F.size(w) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, place(i))), " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    return F.when((h % 10 == 0) & text.isNotNull(), F.transform(F.array(words), tail)[0]).otherwise(text)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = collapsed(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / -F.col("best.period"))
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: The same rows from all pairs of equal words of a document.
OP11_SQL = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents, crc),
c AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tail, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM d),
x AS (SELECT doc_id, n, i, CASE WHEN tail AND i >= a THEN w[a + (i - a) % (1 + (n - a) // k) + 1] ELSE w[i + 1] END AS w FROM (SELECT *, UNNEST(range(n)) AS i FROM c)),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
g AS (SELECT doc_id, q, MIN(i) AS s, COUNT(*) + q AS l FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m) GROUP BY doc_id, q, k HAVING COUNT(*) + q >= GREATEST(6, 4 * q)),
r AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.doc_id = g.doc_id AND o.q < g.q AND o.s <= g.s AND o.s + o.l >= g.s + g.l)),
f AS (SELECT doc_id, COUNT(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_max({{'s': s, 'l': l, 'q': q}}, {{'l': l, 's': -s, 'q': -q}}) AS best FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, UNNEST(range(s + q, s + l)) AS i FROM r),
t AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(COALESCE(lines, '')) AS runs_sha256, sha256(COALESCE(t, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN t USING (doc_id)
"""
