"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
LEAST_HEX, LEAST_ACCESS, LEAST_VALUE, LEAST_STRING = 16, 18, 12, 16
#: Documents of the sample that trains the Markov models, and the least log-likelihood ratio of a secret.
SAMPLE, RATIO = 20_000, 12.0
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_STATE = np.zeros(256, np.uint8)  # 0: outside the alphabet and string start
_STATE[list(_LETTERS)] = np.arange(1, len(_LETTERS) + 1)
STATES = len(_LETTERS) + 1
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(inside: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of maximal runs of true bytes within rows, of least bytes or more."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(inside))]
    split = np.unique(inner[inside[inner - 1] & inside[inner]]) if len(inner) else inner
    if len(split):
        starts, ends = np.sort(np.append(starts, split)), np.sort(np.append(ends, split))
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def _places(data: bytes, word: bytes):
    i = data.find(word)
    while i >= 0:
        yield i
        i = data.find(word, i + 1)


def base_spans(at: np.ndarray, data: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
    """By row of a slab that has any: (start, end, kind) in bytes, unordered; assign spans are the whole match."""
    out: dict[int, list] = {}
    raw = data.tobytes()
    starts, ends = _runs(_HEX[data], at, LEAST_HEX)
    for row, s, e in zip(np.searchsorted(at, starts, "right") - 1, starts.tolist(), ends.tolist()):
        out.setdefault(int(row), []).append((s - int(at[row]), e - int(at[row]), "hex"))
    low = _LOWER[data].tobytes()
    rows = {int(np.searchsorted(at, i, "right")) - 1 for w in _ASSIGN_WORDS for i in _places(low, w)}
    for row in rows:
        for m in _ASSIGN_BYTES.finditer(raw[at[row] : at[row + 1]]):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                out.setdefault(row, []).append((*m.span(), "assign"))
    rows = {int(np.searchsorted(at, i, "right")) - 1 for i in _places(raw, b"AKIA")}
    for row in rows:
        for m in _ACCESS_BYTES.finditer(raw[at[row] : at[row + 1]]):
            if m.end() - m.start() >= LEAST_ACCESS:
                out.setdefault(row, []).append((*m.span(), "access"))
    return out


# The patterns hold ASCII only, so they match the same places of the UTF-8 bytes.
_ASSIGN_BYTES = re.compile(ASSIGN.pattern.encode(), re.IGNORECASE)
_ACCESS_BYTES = re.compile(ACCESS.pattern.encode())


def _strings(at: np.ndarray, data: np.ndarray):
    """(row, start, end) in bytes of the row: maximal runs of the alphabet of LEAST_STRING or more."""
    starts, ends = _runs(_STATE[data] > 0, at, LEAST_STRING)
    row = np.searchsorted(at, starts, "right") - 1
    return row, starts - at[row], ends - at[row]


def _pairs(raw: np.ndarray) -> np.ndarray:
    s = _STATE[raw].astype(np.int64)
    return np.append(0, s[:-1]) * STATES + s


def _samples(batches):
    """Bigram counts of a batch: values of base matches (1) against other strings of letters (0)."""
    for batch in batches:
        total = np.zeros((2, STATES * STATES), np.int64)
        for _, _, at, data in X.slabs(batch.column("text")):
            found = base_spans(at, data)
            taken = np.zeros(len(data) + 1, np.int32)
            for row, spans in found.items():
                for s, e, kind in spans:
                    s, e = s + int(at[row]), e + int(at[row])
                    taken[s] += 1
                    taken[e] -= 1
                    if kind == "assign":
                        s = e - len(_ASSIGN_BYTES.match(data[s:e].tobytes())[2])
                    total[1] += np.bincount(_pairs(data[s:e]), minlength=STATES * STATES)
            free = np.cumsum(taken)[:-1] == 0
            starts, ends = _runs((_STATE[data] > 0) & free, at, 6)
            if len(starts):
                size = ends - starts
                where = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                s = _STATE[data[where]].astype(np.int64)
                before = np.append(0, s[:-1])
                before[np.cumsum(size) - size] = 0
                total[0] += np.bincount(before * STATES + s, minlength=STATES * STATES)
        k, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.int64()), pa.array(total[k, p], pa.int64())], names=["label", "pair", "n"])


def train(documents: DataFrame) -> np.ndarray | None:
    """Log ratio of each transition's probability in random strings and in ordinary identifiers, as a flat table.

    Labelled samples come from documents(doc_id, text) themselves: values of base matches are random strings, other
    runs of the alphabet ordinary ones. At most about SAMPLE documents, drawn by a hash of doc_id, are read. None where
    either label has no sample: then no span is added."""
    n = documents.count()
    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))) if n > SAMPLE else documents
    with X.small_batches(documents.sparkSession):
        rows = some.select("text").mapInArrow(_samples, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, STATES, STATES))
    for r in rows:  # at most 2 * STATES**2 rows
        counts[r.label].flat[r.pair] = r.n
    if not counts.sum((1, 2)).all():
        return None
    p = (counts + 0.5) / (counts + 0.5).sum(2, keepdims=True)
    return np.log(p[1] / p[0]).ravel()


def find(at: np.ndarray, data: np.ndarray, table: np.ndarray | None) -> dict[int, list[tuple[int, int, str]]]:
    """By row: all spans in code points, by start and then kind as listed."""
    out = base_spans(at, data)
    if table is not None:
        for row, s, e in zip(*(x.tolist() for x in _strings(at, data))):
            if all(e <= a or s >= b for a, b, k in out.get(row, ()) if k != "markov"):
                if table[_pairs(data[at[row] + s : at[row] + e])].sum() >= RATIO:
                    out.setdefault(row, []).append((s, e, "markov"))
    for row, spans in out.items():
        own = data[at[row] : at[row + 1]]
        before = np.append(0, np.cumsum((own & 0xC0) != 0x80))
        out[row] = sorted(((int(before[s]), int(before[e]), k) for s, e, k in spans), key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def scan(documents: DataFrame, table: np.ndarray | None) -> DataFrame:
    """(doc_id, spans): the spans of each row's whole text as array<struct<start, end, kind>>; null text has none.

    Patterns match leftmost and without overlap per kind; the Markov models add runs of the alphabet that overlap no
    base span. Repeated rows are each scanned; an empty table gives an empty result."""
    held = documents.sparkSession.sparkContext.broadcast(table)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def make(batches):
        for batch in X.parts(batches):
            for i, j, at, data in X.slabs(batch.column("text")):
                found = find(at, data, held.value)
                rows = [[{"start": s, "end": e, "kind": k} for s, e, k in found.get(r, ())] for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(rows, kind)], names=["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(make, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def redact(documents: DataFrame, table: np.ndarray | None, mark: str = "[SECRET]") -> DataFrame:
    """documents with every span of text replaced by mark and all other columns as they are; n_chars follows the text.

    Null text stays null; empty texts, repeated rows and rows without an id are each judged by their text; an empty table
    gives an empty result."""
    held = documents.sparkSession.sparkContext.broadcast(table)

    def make(batches):
        for batch in X.parts(batches):
            texts = batch.column("text").to_pylist()
            for i, _, at, data in X.slabs(batch.column("text")):
                for r, spans in find(at, data, held.value).items():
                    t, out, last = texts[i + r], [], 0
                    for s, e, _ in spans:
                        if s >= last:
                            out += [t[last:s], mark]
                        last = max(last, e)
                    texts[i + r] = "".join(out) + t[last:]
            column = pa.array(texts, pa.string())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", column)

    out = documents.mapInArrow(make, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def _of(kind: str):
    return lambda x: x["kind"] == kind


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = scan(documents, train(documents))
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    joined = lambda xs: F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    many = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return spans.select("doc_id", *many, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
