"""Rows that share or lack a doc_id, for every operator that tells rows apart, and settings that must stay as they are."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from allelia.llm import decontaminate, near_dedup, packing, secret_scan, substring_dedup, tokens, toxicity, warc
from allelia.llm import text as X

KIND = "doc_id long, text string, lang string"
A, B, C = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("x", 40), ("y", 60), ("z", 50)))
ROWS = [(3, A), (8, A), (8, B), (9, C), (9, C), (None, A), (None, B), (None, B), (None, None), (None, ""), (5, None), (5, ""), (5, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en") for d, t in ROWS], KIND)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_groups_keep_texts_apart(spark, docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(docs).collect())
    assert got == Counter(
        [(3, 36, 3, True), (8, 36, 3, False), (8, 56, 8, True), (9, 46, 9, True), (9, 46, 9, True), (None, 36, None, True), (None, 56, None, True), (None, 56, None, True)]
        + [(None, 0, None, True)] * 2 + [(5, 0, 5, True)] * 2 + [(5, 1, 5, True)]
    )
    # two texts first seen under the same id aren't one node
    near_b = B.replace("y30 ", "other ")
    frame = spark.createDataFrame([(8, A, "a"), (8, B, "b"), (7, near_b, "c"), (10, A, "d")], KIND)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(frame, 80).collect()} == {(8, 36, 8), (8, 56, 7), (7, 56, 7), (10, 36, 8)}


def test_near_duplicates_leave_by_row(docs):
    left = near_dedup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert texts(left) == Counter([(3, A), (8, B), (9, C), (None, A), (None, B), (None, B), (None, None), (None, ""), (5, None), (5, ""), (5, "one")])


def test_near_without_signature_bound(spark):
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for d in range(30):
        w = list(base)
        for k in rng.choice(200, d // 3, replace=False):
            w[k] = f"n{d}_{k}"
        rows.append((d, " ".join(w), "en"))
    frame = spark.createDataFrame(rows, KIND)
    one, two = ({(r.doc_id, r.component_id) for r in near_dedup.near_groups(frame, 80, far).collect()} for far in (None, near_dedup.FAR))
    assert one == two


def test_substrings_keep_texts_apart(docs):
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.factored(docs, substring_dedup._kept, kind).collect())
    # null ids come first: their A and B stay, and so does 9's C; all other copies go, and no unlike text with them
    assert got == Counter([(3, 40, 40), (8, 40, 40), (8, 60, 60), (9, 50, 0), (9, 50, 0), (None, 40, 0), (None, 60, 0), (None, 60, 0), (None, 0, 0), (None, 0, 0), (5, 0, 0), (5, 0, 0), (5, 1, 0)])
    own = docs.where("doc_id IS NOT NULL")
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.factored(own, substring_dedup._kept, kind).collect())
    assert got == Counter([(3, 40, 0), (8, 40, 40), (8, 60, 0), (9, 50, 0), (9, 50, 0), (5, 0, 0), (5, 0, 0), (5, 1, 0)])


def test_leaks_leave_by_row(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(B.split()[5:40]))], "item_id long, text string")
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and texts(left) == Counter({k: n for k, n in texts(docs).items() if k[1] != B})


def test_short_documents_leak(spark):
    item = " ".join(f"q{i}" for i in range(38))
    rows = [(1, " ".join(item.split()[:-1])), (2, " ".join(item.split()[:32])), (3, " ".join(item.split()[:31])), (4, "q0 q1"), (5, item)]
    got = {r.doc_id: (r.start_word, r.similarity) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (0, 33 / 34), 2: (0, 28 / 34), 5: (0, 1.0)}


def test_blocks_select():
    """The index returns few of the unrelated windows, and every window within the radius."""
    rng = np.random.default_rng(5)
    items, windows = (rng.integers(0, 2**63, (n, decontaminate.BLOCKS), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, decontaminate.BLOCKS), dtype=np.uint64) for n in (200, 5000))
    w, _ = decontaminate.candidates(windows, items)
    assert len(w) / (len(items) * len(windows)) < 1 / 250
    near = np.repeat(items, 20, 0)
    for row in near:
        for bit in rng.choice(64 * decontaminate.BLOCKS, decontaminate.RADIUS, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    w, i = decontaminate.candidates(near, items)
    assert {(k, k // 20) for k in range(len(near))} <= set(zip(w.tolist(), i.tolist()))


def test_packing_ties(spark):
    """Many rows without an id, with equal lengths, different texts and copies: no piece is lost or doubled."""
    rows = [(None, f"a{i % 700} b", "en") for i in range(3000)] + [(7, f"c{i % 5}", "en") for i in range(500)] + [(None, "", "en")] * 900
    got = packing.pack(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    enc = tokens.encoder(tokens.default_path())
    want = Counter((d, zlib.crc32(enc.ids(t).tobytes() + b"\1\0\0\0")) for d, t, _ in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(v)[:k]) == o for v in at.values() for k, (o, _) in enumerate(sorted(v)))


def test_secrets_by_row(spark):
    secret = "token=abcdefghijkl1234"
    rows = [(8, secret, "a"), (8, "plain", "b"), (None, secret, "c"), (None, None, "d"), (None, "", "e")]
    out = {r.lang: r.text for r in secret_scan.redact(spark.createDataFrame(rows, KIND), None).collect()}
    assert out == {"a": "[SECRET]", "b": "plain", "c": "[SECRET]", "d": None, "e": ""}


def test_settings_stay(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    X.table(near_dedup.without_near_duplicates(docs), "left")
    packing.pack(docs).count()
    with pytest.raises(ValueError), X.small_batches(spark):
        assert int(spark.conf.get(key)) == X.BATCH_ROWS
        raise ValueError
    assert spark.conf.get(key) == before


def test_archives_of_repeated_ids(spark):
    """Rows that share a page_id each have a record of their own payload; equal payloads of the least id are all responses."""
    magic = "a WARC/1.1 b"
    rows = [(1, "u", "one"), (1, "u", "two"), (1, "u", "one"), (2, "u", "one"), (2, "u", magic), (3, "u", magic), (3, "v", None), (None, "u", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = X.scratch(spark, "warc")
    warc.write_archives(pages, path)
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.pages_of(warc.read_archives(spark, path)).collect())
    assert spark.conf.get(key, None) == before
    assert got == Counter(
        [(1, 3, "response", None)] * 3 + [(2, 3, "revisit", 1), (2, 12, "response", None), (3, 12, "revisit", 2), (3, 0, "response", None), (None, 3, "revisit", 1)]
    )


def test_key_columns_of_documents_stay(spark):
    """Columns named as the stages' own ones keep their values."""
    names = ["__row", "row_key", "ROW_KEY_", "row", "id", "runs", "letter", "digest", "first", "keys", "toxic"]
    rows = [(d, t, *[f"{n}{k}" for n in names]) for k, (d, t) in enumerate([*ROWS, (20, A.replace("x3 ", "other "))])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = near_dedup.without_near_duplicates(frame).collect()
    assert set(map(tuple, kept)) < set(rows) and Counter((r.doc_id, r.text) for r in kept) == texts(near_dedup.without_near_duplicates(frame.select("doc_id", "text")))
    items = spark.createDataFrame([(1, B)], "item_id long, text string")
    clean = decontaminate.without_leaks(frame, items).collect()
    assert sorted(map(str, map(tuple, clean))) == sorted(str(r) for r in rows if r[1] != B)
    for out in (secret_scan.redact(frame, None), toxicity.without_toxic(frame, toxicity.fit(np.zeros(0, np.uint64), [], [], 0.1))):
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, rows))


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    """Thousands of rows under one id bring no more rows to the driver than the sample may have."""
    monkeypatch.setattr(toxicity, "TOXIC_DOCS", 40)
    monkeypatch.setattr(toxicity, "OTHER_DOCS", 60)
    rows = [(1, f"vile scum {k}") for k in range(3000)] + [(d, f"nice day {d}") for d in range(2, 300)] + [(d, f"vile scum of {d}") for d in range(300, 330)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d == 1 or d >= 300)) for d in range(1, 330)], "doc_id long, toxic int")
    held = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda names, toxic, other, prior: held.append((len(toxic), len(other))) or fit(names, toxic, other, prior))
    model = toxicity.train(frame, labels)
    assert held == [(40, 60)]
    assert all(0 <= r.score <= 1 for r in toxicity.score(frame, model).collect())
