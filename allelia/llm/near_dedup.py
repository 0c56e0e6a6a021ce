"""MinHash near-dedup by a multi-index Hamming join."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X
from .graph import components

#: Positions of a signature, chunks, and errors that a chunk may have. Pairs that differ in at most
#: CHUNKS * (ERRORS + 1) - 1 = 15 positions share a key for certain.
POSITIONS, CHUNKS, ERRORS = 40, 8, 1
#: Unequal positions up to which a pair that shares a key is verified. Of pairs at a similarity of 0.8, under one in
#: 10^10 has more, at 0.85 under one in 10^14: far less than the index itself may miss.
FAR = 28
ROW = "struct<doc_id: bigint, t1: bigint, t2: bigint>"
#: Documents that may hold a shingle for it to count as rare.
RARE = 8
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def masks() -> list[tuple[int, list[int]]]:
    """(chunk, positions kept) of every key: the enumeration of the allowed chunk errors."""
    size = POSITIONS // CHUNKS
    return [(c, [c * size + i for i in range(size) if i not in gone]) for c in range(CHUNKS) for gone in combinations(range(size), ERRORS)]


def minhash(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(rows, POSITIONS) 16-bit signatures of rows whose shingle hashes lie one after another; counts are over 0."""
    at = np.cumsum(counts) - counts
    out = np.empty((len(counts), POSITIONS), np.uint16)
    for k in range(POSITIONS):
        out[:, k] = X.mix(np.minimum.reduceat(sets * _SEEDS[k], at)) & np.uint64(0xFFFF)
    return out


def row_sets(column: pa.Array):
    """(first row, end row, hashes sorted within rows, counts of the rows) of whole texts in slabs."""
    for i, j, at, data in X.slabs(column):
        h, first, _, _ = X.words(at, data, lower=True)
        s, row, _ = X.shingles(h, first)
        order = np.lexsort((s, row))
        s, row = s[order], row[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        s, row = s[new], row[new]
        yield i, j, s, np.bincount(row, minlength=j - i)


def _sketch(batches):
    kept = masks()
    for batch in batches:
        for i, j, s, counts in row_sets(batch.column("text")):
            rows = batch.column("row").slice(i, j - i)
            some = np.flatnonzero(counts)
            digest = np.zeros((2, j - i), np.uint64)
            sig = np.zeros((len(some), POSITIONS), np.uint16)
            keys = np.zeros((len(some), len(kept)), np.uint64)
            if len(some):
                at = (np.cumsum(counts) - counts)[some]
                digest[0, some] = np.add.reduceat(X.mix(s ^ np.uint64(0x5851F42D4C957F2D)), at)
                digest[1, some] = np.add.reduceat(X.mix(s + np.uint64(0x14057B7EF767814F)), at)
                sig = minhash(s, counts[some])
                for k, (chunk, where) in enumerate(kept):
                    h = np.full(len(some), k, np.uint64)
                    for p in where:
                        h = X.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, p] + np.uint64(1))
                    keys[:, k] = h
            blobs = np.zeros(j - i, object)
            blobs[:] = None
            blobs[some] = [x.tobytes() for x in sig]
            per = np.zeros(j - i, np.int64)
            per[some] = len(kept)
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(counts, pa.int64()), pa.array(X.signed(digest[0])), pa.array(X.signed(digest[1])), pa.array(blobs, pa.binary()), X.arrow_lists(X.signed(keys.ravel()), per, pa.int64())],
                names=["row", "n_shingles", "lo", "hi", "sig", "keys"],
            )


def _sets(batches):
    for batch in batches:
        for i, j, s, counts in row_sets(batch.column("text")):
            ends = np.cumsum(counts)
            blobs = [s[e - c : e].tobytes() for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(blobs, pa.binary())], names=["id", "shingles"])


def _shingles(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            sets = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column("shingles")]
            ids = np.repeat(part.column("id").to_numpy(), [len(v) for v in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets))], names=["id", "s"])


def _rare_pairs(rest: DataFrame, sets: DataFrame, threshold: int, table) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from members rest(key, id, g, n) of open buckets.

    Shingles are ordered by how many of these documents hold them. A linked pair whose first shingle in common is in at
    most RARE documents has it in both documents' first n - ceil(t n) + 1, so a join on such shingles finds it, with RARE
    partners each. Any other linked pair has only frequent shingles in common, which bounds its similarity by how many
    of these either has: a document that the bound leaves without a partner takes no part, the rest meet by bucket key.
    """
    size_ok = lambda n, m: 100 * F.least(n, m) >= threshold * F.greatest(n, m)
    docs = rest.select("id", "g", "n").distinct()
    held = table(sets.join(docs.select("id"), "id", "left_semi").mapInArrow(_shingles, "id long, s long"), "shingles")
    often = table(held.groupBy("s").agg(F.count("*").alias("f")), "often")
    held = held.join(often, "s")
    many = held.groupBy("id").agg(F.sum(F.when(F.col("f") > 1, 1).otherwise(0)).alias("n_shared"), F.sum(F.when(F.col("f") > RARE, 1).otherwise(0)).alias("c"))
    docs = table(docs.join(many, "id").where(100 * F.col("n_shared") >= threshold * F.col("n")), "bounded")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("f", "s"))
    first = held.join(docs.select("id", "g", "n"), "id").withColumn("r", rank).where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1) & F.col("f").between(2, RARE))
    first = table(first.select("s", "id", "g", "n"), "rare")
    other = first.select("s", F.col("id").alias("b"), F.col("g").alias("h"), F.col("n").alias("m"))
    rare = first.join(other, "s").where((F.col("id") < F.col("b")) & (F.col("g") != F.col("h")) & size_ok(F.col("n"), F.col("m"))).select(F.col("id").alias("a"), "b")
    left = rest.select("key", "id").join(docs, "id")
    least = left.groupBy("key").agg(F.min("n").alias("m0"))
    left = left.join(least, "key").where(100 * F.col("c") >= threshold * (F.col("n") + F.greatest("m0", "c") - F.col("c")))
    left = table(left.select("key", "id", "g", "n", "c"), "frequent")
    right = left.select("key", F.col("id").alias("b"), F.col("g").alias("h"), F.col("n").alias("m"), F.col("c").alias("d"))
    most = F.least("c", "d")
    by_key = left.join(right, (left.key == right.key) & (left.id < right.b) & (left.g != right.h) & (100 * most >= threshold * (F.col("n") + F.col("m") - most)))
    return rare.unionAll(by_key.select(F.col("id").alias("a"), "b"))


def _links(threshold: int):
    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[k] = 100 * same >= threshold * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])

    return check


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs(a, b) whose full shingle sets have a similarity of threshold hundredths or more."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(_links(threshold), "a long, b long")


def _apart(x: str, y: str):
    """The number of unequal positions of two signatures, in JVM expressions over their hex forms."""
    return F.expr(f"{POSITIONS} - aggregate(sequence(0, {POSITIONS - 1}), 0, (n, i) -> n + if(substring({x}, 2 * i + 1, 2) = substring({y}, 2 * i + 1, 2), 1, 0))")


def near_rows(documents: DataFrame, threshold: int = 85, far: int | None = FAR) -> DataFrame:
    """(row, n_shingles, component_id, first) of documents(doc_id, text), one row per row: its text.row_key(), its set's size,
    its group's smallest doc_id, and whether it is its group's least row_key(); the last two are null for rows that are
    linked with nothing as they lack words or an id.

    Texts of equal sets are one class, known by its least row. Classes' 16-bit minhash signatures are split into chunks;
    a key is a chunk without ERRORS of its positions, so that equal keys mean at most as many errors. Each bucket's
    members are first verified against its best connected member only; then, in buckets that still hold several
    components, against those members of other components that rare shingles or counts of the frequent ones leave
    open. So a group of thousands of copies costs a star, and no pair of different components goes unchecked.

    What the index can miss: a pair at the limit whose eight chunks all have two errors or more, with probability 6e-7 at
    a similarity of 0.85 and 2.3e-5 at 0.8, less above. Pairs with over far unequal positions aren't verified; None
    verifies all. What joins by a bucket's, shingle's or group's key has its other side written first, so that Spark can
    split a hot key's rows among tasks.
    """
    spark = documents.sparkSession
    docs = documents.select(X.row_key().alias("row"), "text")
    with X.passing_tables(spark) as table:
        sketch = table(docs.mapInArrow(_sketch, f"row {ROW}, n_shingles long, lo long, hi long, sig binary, keys array<long>"), "sketch")
        full = sketch.where("n_shingles > 0 AND row.doc_id IS NOT NULL")
        classes = table(full.groupBy("lo", "hi", "n_shingles").agg(F.min("row").alias("first")), "classes").withColumn("id", F.col("first.doc_id"))
        repeated = full.groupBy("row.doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0
        if repeated:  # different texts under one id: these classes are known by a hash
            shared_ids = table(classes.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id", F.lit(True).alias("again")), "shared_ids")
            other = F.xxhash64("lo", "hi").bitwiseOR(F.lit(-(1 << 63)))
            classes = table(classes.join(shared_ids, "id", "left").withColumn("id", F.when(F.col("again"), other).otherwise(F.col("id"))).drop("again"), "classes")
        reps = full.select("row", "sig", "keys").join(classes.select(F.col("first").alias("row"), "id", F.col("n_shingles").alias("n")), "row")
        reps = reps.dropDuplicates(["id"]) if repeated else reps
        member = reps.select("id", F.explode("keys").alias("key"))
        shared = member.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key", "c")
        member = table(member.join(table(shared, "shared"), "key"), "members")
        facts = table(reps.join(member.select("id").distinct(), "id", "left_semi").select("id", "n", "sig", "row"), "facts")
        wanted = facts.select("id", "row")
        texts = docs.join(F.broadcast(wanted) if facts.count() <= X.BROADCAST_KEYS else wanted, "row").select("id", "text")
        sets = texts.mapInArrow(_sets, "id long, shingles binary")
        sets = table(sets.dropDuplicates(["id"]) if repeated else sets, "sets")
        support = member.groupBy("id").agg(F.sum("c").alias("s"))
        lead = table(member.join(support, "id").groupBy("key").agg(F.max_by("id", F.struct("s", -F.col("id"))).alias("lead")), "lead")

        def near(pairs):
            for x in "ab":
                pairs = pairs.join(facts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"g{x}")), x)
            pairs = pairs.where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
            return (pairs if far is None else pairs.where(_apart("ga", "gb") <= far)).select("a", "b")

        stars = member.join(lead, "key").where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        stars = table(stars.distinct(), "pairs")
        edges = table(verified(near(stars), sets, threshold), "stars")
        now = table(components(edges), "components")
        placed = member.join(now, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g"))
        open_ = placed.groupBy("key").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("key")
        rest = table(placed.join(open_, "key").join(facts.select("id", "n"), "id"), "open")
        pairs = _rare_pairs(rest, sets, threshold, table)
        cross = pairs.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
        more = table(verified(near(cross), sets, threshold), "cross")
        if more.limit(1).count():  # the components found so far are stars, too
            now = table(components(now.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")
        named = classes.join(now, "id", "left").withColumn("component", F.coalesce("component", "id"))
        if repeated:
            leads = table(named.groupBy("component").agg(F.min("first").alias("least")), "leads")
            named = named.join(leads, "component").select("lo", "hi", F.col("least.doc_id").alias("component_id"), "least")
            first = F.col("row") == F.col("least")
        else:  # the label is the smallest id
            named = named.select("lo", "hi", F.col("component").alias("component_id"))
            first = F.col("row.doc_id") == F.col("component_id")
        out = full.join(table(named, "named"), ["lo", "hi"]).select("row", "n_shingles", "component_id", first.alias("first"))
        alone = sketch.where("n_shingles = 0 OR row.doc_id IS NULL").select("row", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("boolean").alias("first"))
        return X.table(out.unionAll(alone), "near")


def near_groups(documents: DataFrame, threshold: int = 85, far: int | None = FAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents(doc_id, text), one row per row.

    Words are lower-cased (A-Z). A text's set holds its distinct 5-word shingles, with fewer words its whole sequence;
    texts that are null or have no word have an empty set and are linked with nothing. Texts with a similarity of
    threshold hundredths or more are linked (near_rows says how, and what it can miss); component_id is the smallest
    doc_id reachable. A null doc_id keeps a null component and is kept. Rows that repeat a doc_id are each placed by
    their own text, and different texts under one id are linked by their texts alone. An empty table gives an empty result.
    """
    own, group = F.col("row.doc_id"), F.coalesce("component_id", "row.doc_id")
    return near_rows(documents, threshold, far).select(own.alias("doc_id"), "n_shingles", group.alias("component_id"), F.coalesce(own == group, F.lit(True)).alias("kept"))


def without_near_duplicates(documents: DataFrame, threshold: int = 80, far: int | None = FAR) -> DataFrame:
    """documents with one row of each group of near-duplicates: that with the smallest doc_id, of texts under this id
    that with the least hash, of identical rows (same id and text) any one. Rows go by id and text together, so a text
    whose id another row has too is judged by itself. Rows without words or without an id all stay."""
    rows = near_rows(documents, threshold, far)
    twice = X.table(rows.where("first").groupBy("row").agg(F.count("*").alias("c")).where("c > 1").select("row"), "twice")
    left = X.without(documents, rows.where("NOT first"))
    return X.once(left, twice) if twice.limit(1).count() else left


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows from all pairs that share a shingle.
OP5_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, UNNEST(range(1, GREATEST(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT id, MIN(c) AS c FROM r GROUP BY 1)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON id = doc_id
"""
