"""Periodic runs, SimHash near-dedup and the Merkle manifest against brute force, with the awkward rows of their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from allelia.llm import manifest, periodic_runs, simhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, pos string, node string, row string, fp int, runs int, cell long, tie int, g long, at int, path string"
BASE = " ".join(f"base{i}" for i in range(400))
ROWS = [
    (5, "Alpha beta  gamma\tdelta\nEPSILON zeta", "en"), (6, None, "en"), (7, "", None), (8, "   ", None), (9, "one two", "de"), (10, "ONE two", "é"), (11, BASE, "zz"), (12, BASE.upper(), "en"),
    (14, "la " * 300, "en"), (14, "la " * 300, "en"), (14, "lo li " * 9 + BASE, "en"), (None, "a b c " * 40 + "end", "en"), (None, "a b c " * 40 + "end", "en"), (15, BASE + " " + "x y " * 5000, None),
    (16, "éß 中文 café " * 9, "de"), (17, " ".join(["p q r s t"] * 6 + ["p q r"] + ["z"] * 6), "en"), (18, "tick " * 5, "en"), (19, "a a b a a b a a b a a b a a b a a b", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, lang, "s" if d != 9 else None, len(t) if t else None, *[None] * 11) for d, t, lang in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    return WORD.findall((t or "").translate(LOWER) if lower else t or "")


# ---- 11: periodic runs -----------------------------------------------------------------------------------------------


def runs_by_hand(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q) and not any(p < q and a <= s and a + n >= i + q for a, n, p in found):
                found.append((s, i - s + q, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(t):
    w = words(t)
    runs = runs_by_hand(w)
    return len(w), runs, " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic_words(rng, longest):
    w = rng.integers(0, rng.integers(1, 5), rng.integers(0, 120)).tolist()
    for _ in range(rng.integers(0, 3)):
        if len(w) > 8:
            a, p = rng.integers(0, len(w) - 1), rng.integers(1, 30)
            base = w[a : a + p]
            w[a:a] = [base[i % len(base)] for i in range(rng.integers(1, longest))]
    return w


@pytest.mark.parametrize("wide, strip", [(1, 16), (256, 8192), (1, 8192)])
def test_fragments_kernel(monkeypatch, wide, strip):
    monkeypatch.setattr(periodic_runs, "WIDE", wide)
    monkeypatch.setattr(periodic_runs, "STRIP", strip)
    rng = np.random.default_rng(wide + strip)
    for trial in range(150):
        rows = [periodic_words(rng, 600 if trial % 5 == 0 else 150) for _ in range(rng.integers(1, 6))]
        h = np.array([x + 7 for w in rows for x in w], np.uint64)
        first = np.cumsum([0] + [len(w) for w in rows])
        got = {r: [] for r in range(len(rows))}
        for r, q, s, e in periodic_runs.fragments(h, first):
            got[r].append((s, e - s + q, q))
        for r, w in enumerate(rows):
            assert sorted(got[r], key=lambda x: (x[0], x[2])) == runs_by_hand(w)


def test_z_values():
    rng = np.random.default_rng(2)
    for n in [0, 1, 2, *rng.integers(3, 60, 40)]:
        x = rng.integers(0, 2, n).tolist()
        assert periodic_runs.z_values(x) == [next((k for k in range(n - i) if x[k] != x[i + k]), n - i) for i in range(n)]


@pytest.mark.parametrize("spread", [periodic_runs.SPREAD, 40])
def test_collapsed_awkward_rows(spark, docs, none, spread):
    got = periodic_runs.collapsed(docs, spread).collect()
    found = sorted((str(r.doc_id), r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.text) for r in got)
    assert found == sorted((str(d), *collapsed_by_hand(t)) for d, t, _ in ROWS)
    assert periodic_runs.collapsed(none, spread).count() == 0


def test_op11_plants_tails(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("new")).collect()
    changed = 0
    for r in rows:
        h, w = zlib.crc32(str(r.doc_id).encode()), words(r.text)
        if h % 10 or not w:
            assert r.new == r.text
            continue
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert words(r.new) == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        changed += 1
    assert changed > 5


# ---- 12: SimHash -----------------------------------------------------------------------------------------------------


def print_by_hand(t):
    w = words(t, True)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(prints):
    parent = {f: f for f in set(prints)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def test_cell_bounds_distance(spark):
    rng = np.random.default_rng(4)
    values = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 200)] + [0, -1, -(2**63), 2**63 - 1]
    got = spark.createDataFrame([(v,) for v in values], "fp long").select("fp", simhash_dedup.cell(F.col("fp")).alias("c")).collect()
    for r in got:
        assert [(r.c >> 4 * j) & 15 for j in range(16)] == [((r.fp & (2**64 - 1)) >> 4 * j & 15).bit_count() for j in range(16)]


@pytest.mark.parametrize("small", [2, 16])
def test_links_connect_all_near_numbers(spark, monkeypatch, small):
    """Chains, a ball of numbers around one and far numbers; with a small limit nearly all cells are crowded."""
    monkeypatch.setattr(simhash_dedup, "SMALL", small)
    rng = np.random.default_rng(5)
    core = [int(x) for x in rng.integers(0, 2**63, 60)] + [0, 2**64 - 1]
    near = {c ^ (1 << int(a)) ^ (1 << int(b)) for c in core[:40] for a, b in rng.integers(0, 64, (3, 2))}
    ball = {core[0] ^ (1 << a) for a in range(64)} | {core[1] ^ (1 << a) ^ (1 << a + 1) ^ (1 << a + 2) for a in range(0, 60, 5)}
    values = sorted({*core, *near, *ball})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = simhash_dedup.links(spark.createDataFrame([(signed(v),) for v in values], "fp long")).collect()
    pairs = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in rows]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    want, parent = groups_by_hand(values), {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    split = lambda f: {frozenset(v for v in values if f(v) == g) for g in set(map(f, values))}
    assert split(find) == split(want.get)


def test_simhash_awkward_rows(spark, docs, none):
    rows = simhash_dedup.near_groups(docs).collect()
    prints = [(d, print_by_hand(t)) for d, t, _ in ROWS]
    label = groups_by_hand([f for _, f in prints])
    least = {g: min((d for d, f in prints if label[f] == g and d is not None), default=None) for g in label.values()}
    assert sorted(map(str, ((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in rows))) == sorted(map(str, ((d, f, least[label[f]]) for d, f in prints)))
    assert simhash_dedup.near_groups(none).count() == 0
    alone = simhash_dedup.near_groups(docs.where("doc_id IS NULL")).collect()
    assert [r.component_id for r in alone] == [None, None]


# ---- 13: Merkle manifest ---------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_by_hand(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_by_hand(nodes):
    """(root, each node's siblings from its level up as (left, right))."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            paths[k].append((nodes[p - 1], "") if p % 2 else ("", nodes[p + 1] if p + 1 < len(nodes) else ""))
            place[k] = p // 2
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def manifest_by_hand(rows):
    """{(doc_id, leaf): [(subroot, root, path), ...]} of rows (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf_by_hand(*r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(groups[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = (own, *tree_by_hand([x for _, x in own]))
    root, above = tree_by_hand([trees[lang][1] for lang in langs])
    out: dict = {}
    for lang, top in zip(langs, above):
        own, subroot, paths = trees[lang]
        for key, path in zip(own, paths):
            out.setdefault(key, []).append((subroot, root, tuple(path + top)))
    return out


@pytest.mark.parametrize("bits", [1, 2, 8])
def test_proofs(spark, docs, none, monkeypatch, bits):
    """All block sizes give the same tree; repeated, null and identical rows have places of their own."""
    monkeypatch.setattr(manifest, "BITS", bits)
    for name in ("_HEIGHT", "_LEVELS", "_FLANKS"):
        monkeypatch.setattr(manifest, name, getattr(manifest, name).replace("least(8,", f"least({bits},"))
    got: dict = {}
    rows = manifest.proofs(docs, carry={"size": F.length("text")}).select("*", manifest.fold(F.col("leaf"), F.col("path")).alias("folded"), manifest.siblings(F.col("path")).alias("proof")).collect()
    for r in rows:
        assert r.folded == r.root and r.proof == digest(*[s.left + s.right for s in r.path])
        got.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, tuple((s.left, s.right) for s in r.path)))
    want = manifest_by_hand([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(str(r["size"]) for r in rows) == sorted(str(None if t is None else len(t)) for _, t, _ in ROWS)
    assert manifest.proofs(none).count() == 0


def test_manifest_groups(spark, docs, none):
    want = manifest_by_hand([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    got = manifest.manifest(docs).collect()
    assert {r.lang for r in got} == {x for _, _, x in ROWS} and sum(r.leaves for r in got) == len(ROWS)
    assert {r.subroot for r in got} == {x[0] for v in want.values() for x in v} and len({r.root for r in got}) == 1
    assert manifest.manifest(none).count() == 0


def test_op13_finds_tampering(spark, sf_dir):
    rows = manifest.op13(spark, sf_dir).collect()
    bad = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
    assert bad and {r.doc_id for r in rows if not r.verified} == bad


# ---- SQL -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_tiled_runs", "op12_popcount_simhash", "op13_merkle_levels"])
def test_sql(spark, sf_dir, name):
    import duckdb

    from allelia.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    told = con.sql(queries.ORACLES[name])
    assert sorted(told.columns) == sorted(found.columns)
    at = [told.columns.index(c) for c in found.columns]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in told.fetchall())
