"""SimHash near-dedup: fingerprints meet in a grid of segment popcounts, whose Manhattan distance bounds theirs from below."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .graph import components

#: Words of a shingle; seed of its XXH64; differing bits up to which fingerprints are linked; bits of a segment.
SHINGLE, SEED, RADIUS, SEGMENT = 3, 42, 2, 4
#: Fingerprints of a cell up to which its pairs are verified one by one.
SMALL = 16
#: Shingles hashed at once.
CHUNK = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _spans(at: np.ndarray, data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words in lower case with one space after each, starts and ends of the rows' shingles in it, each row's count)."""
    _, first, starts, ends = X.words(at, data, lower=True)
    lens, count = ends - starts, np.diff(first)
    place = np.cumsum(lens + 1) - lens - 1
    flat = np.full(int((lens + 1).sum()), 32, np.uint8)
    inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    flat[np.repeat(place, lens) + inside] = _LOWER[data[np.repeat(starts, lens) + inside]]
    many = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    k = np.repeat(first[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(k + SHINGLE, np.repeat(first[1:], many)) - 1
    return flat.tobytes(), place[k], place[last] + lens[last], many


def _prints(batches):
    for batch in batches:
        for i, j, at, data in X.slabs(batch.column("text")):
            flat, starts, ends, many = _spans(at, data)
            row = np.repeat(np.arange(j - i), many)
            set_bits = np.zeros((j - i, 64), np.int64)
            for k in range(0, len(row), CHUNK):
                part = slice(k, k + CHUNK)
                h = np.array([xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())], "<u8")
                own = row[part]
                begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                set_bits[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
            packed = np.packbits(2 * set_bits > many[:, None], axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(packed)], names=["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of documents(doc_id, text), one row per row: the 64-bit SimHash of the text's 3-word shingles.

    Words are lower-cased (A-Z) and joined by a space, shingles count as often as they occur, a text of fewer words is one
    shingle. A bit is 1 if it is set in over half the shingles' XXH64, so a text that is null or has no word has 0."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, fp long")


def cell(fp: Column) -> Column:
    """The popcounts (0 to 4) of a fingerprint's 16 segments, one in each hexadecimal digit of a long."""
    out = []
    for half in (F.shiftrightunsigned(fp, 32), fp.bitwiseAND(0xFFFFFFFF)):
        for step, mask in ((1, 0x55555555), (2, 0x33333333)):
            half = half.bitwiseAND(mask) + F.shiftright(half, step).bitwiseAND(mask)
        out.append(half)
    return F.shiftleft(out[0], 32).bitwiseOR(out[1])


#: The grid cells at a Manhattan distance of 0 and 1 from a fingerprint's own.
_AROUND = (
    "concat(array(cell), filter(flatten(transform(sequence(0, 15), j -> array("
    f"if((shiftright(cell, 4 * j) & 15) > 0, cell - shiftleft(1L, 4 * j), null), if((shiftright(cell, 4 * j) & 15) < {SEGMENT}, cell + shiftleft(1L, 4 * j), null)))), c -> c IS NOT NULL))"
)
#: All numbers within one bit of a fingerprint.
_WITHIN_ONE = "concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))"


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links among prints(fp), distinct 64-bit numbers, that connect all those which differ in at most 2 bits.

    A fingerprint lies at the popcounts of its 16 segments; the Manhattan distance of two such places is a lower bound of
    the differing bits. Two places at a distance of at most 2 have a cell of the grid within 1 of both, so each fingerprint
    enters its own cell and those around it (33 at most), and equal cells are joined. In a cell of up to SMALL fingerprints
    every pair is verified. Members of fuller cells are verified without pairs: two numbers differ in at most 2 bits exactly
    if a third is within one bit of both, so all that share such a number are linked with the least of them (65 rows each,
    once, whatever the number of their cells). So the work is linear in the fingerprints, and no link is lost. Of the joins by
    a cell or a number, the side with one row a key is written first, so that Spark can split a hot key's rows.
    """
    with X.passing_tables(prints.sparkSession) as table:
        placed = prints.select("fp", cell(F.col("fp")).alias("cell")).select("fp", F.expr(f"explode({_AROUND})").alias("cell"))
        placed = table(placed, "placed")
        shared = table(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        both = table(placed.join(shared, "cell"), "both")
        few = both.where(F.col("n") <= SMALL).select("cell", F.col("fp").alias("a"))
        pairs = few.join(few.select("cell", F.col("a").alias("b")), "cell").where("a < b")
        near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b").distinct()
        crowd = both.where(F.col("n") > SMALL).select("fp").distinct()
        around = table(crowd.select("fp", F.expr(f"explode({_WITHIN_ONE})").alias("near")), "around")
        least = table(around.groupBy("near").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("near", "b"), "least")
        stars = around.join(least, "near").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
        return X.table(near.unionAll(stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)), "links")


def near_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of documents(doc_id, text), one row per row.

    component_id is the smallest doc_id that links of at most 2 differing bits reach; texts that are null or have no word have
    fingerprint 0, which is linked like any other. Rows that repeat a doc_id, or lack it, are placed by their text; a group
    in which no row has an id has a null component. An empty table gives an empty result."""
    with X.passing_tables(documents.sparkSession) as table:
        prints = X.table(fingerprints(documents), "prints")
        each = table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
        groups = table(components(links(each)), "components").withColumnRenamed("id", "fp")
        placed = table(each.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label")), "placed")
        label = table(placed.groupBy("label").agg(F.min("least").alias("component_id")), "labels")
        named = X.table(placed.join(label, "label").select("fp", "component_id"), "named")
    side = F.broadcast(named) if named.count() <= X.BROADCAST_KEYS else named
    return prints.join(side, "fp").select("doc_id", "fp", "component_id")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _xxh64_sql(rows: str) -> str:
    """DuckDB's common table expressions from x0(s, x, n) (a text, its UTF-8 bytes in hex, their number) to xxh(s, h), of rows(s)."""
    number = lambda v: f"{v % (1 << 64)}::UHUGEINT"
    mod = lambda v: f"(({v}) % {1 << 64}::UHUGEINT)"
    times = lambda a, b: mod(f"({a}) * {number(b)}")
    turn = lambda v, r: f"{mod(f'({v}) << {r}')} | (({v}) >> {64 - r})"
    read = lambda at, k: "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(k))) + ")::UBIGINT::UHUGEINT"
    each = lambda start, items, step: f"list_reduce(list_prepend(({start})::UHUGEINT, {items}), lambda h, k: {step})"
    mixed = lambda k: times(turn(times(k, P2), 31), P1)
    stripes = []
    for j, start in enumerate((SEED + P1 + P2, SEED + P2, SEED, SEED - P1)):
        items = f"list_transform(range(n // 32), lambda i: {read(f'32 * i + {8 * j}', 8)})"
        stripes.append(f"{each(number(start), items, times(turn(mod('h + ' + times('k', P2)), 31), P1))} AS v{j}")
    total = mod(" + ".join(f"({turn(f'v{j}', r)})" for j, r in enumerate((1, 7, 12, 18))))
    lists = ("[v0, v1, v2, v3]", "list_transform(range(n % 32 // 8), lambda i: " + read("n // 32 * 32 + 8 * i", 8) + ")", f"CASE WHEN n % 8 >= 4 THEN [{read('n // 8 * 8', 4)}] ELSE []::UHUGEINT[] END", "list_transform(range(n % 4), lambda i: " + read("n // 4 * 4 + i", 1) + ")")
    steps = (
        mod(times(f"xor(h, {mixed('k')})", P1) + f" + {number(P4)}"),
        mod(times(turn(f"xor(h, {mixed('k')})", 27), P1) + f" + {number(P4)}"),
        mod(times(turn(f"xor(h, {times('k', P1)})", 23), P2) + f" + {number(P3)}"),
        times(turn(f"xor(h, {times('k', P5)})", 11), P1),
    )
    out = [f"x0 AS (SELECT s, hex(s) AS x, strlen(s) AS n FROM {rows})", f"x1 AS (SELECT *, {', '.join(stripes)} FROM x0)"]
    out.append(f"x2 AS (SELECT s, x, n, {mod(f'CASE WHEN n >= 32 THEN {each(total, lists[0], steps[0])} ELSE {number(SEED + P5)} END + n::UHUGEINT')} AS h0 FROM x1)")
    for k in (1, 2, 3):
        out.append(f"x{k + 2} AS (SELECT s, x, n, {each(f'h{k - 1}', lists[k], steps[k])} AS h{k} FROM x{k + 1})")
    out.append(f"x6 AS (SELECT s, {times('xor(h3, h3 >> 33)', P2)} AS a FROM x5), x7 AS (SELECT s, {times('xor(a, a >> 29)', P3)} AS b FROM x6), xxh AS (SELECT s, xor(b, b >> 32)::UBIGINT AS h FROM x7)")
    return ",\n".join(out)


#: The same rows from all pairs of fingerprints.
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, UNNEST(range(1, GREATEST(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
t AS (SELECT DISTINCT s FROM s),
{_xxh64_sql("t")},
b AS (SELECT doc_id, b, 2 * SUM((h >> b::UBIGINT) & 1) > COUNT(*) AS up FROM s JOIN xxh USING (s), range(64) r(b) GROUP BY doc_id, b),
f AS (SELECT doc_id, COALESCE(fp, 0::UBIGINT) AS fp FROM documents LEFT JOIN (SELECT doc_id, BIT_OR(CASE WHEN up THEN 1::UBIGINT << b::UBIGINT ELSE 0::UBIGINT END) AS fp FROM b GROUP BY doc_id) USING (doc_id)),
g AS (SELECT DISTINCT fp FROM f),
e AS (SELECT x.fp AS a, y.fp AS b FROM g x JOIN g y ON bit_count(xor(x.fp, y.fp)::HUGEINT) <= 2),
r(fp, c) AS (SELECT fp, fp FROM g UNION SELECT r.fp, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT r.fp, MIN(doc_id) AS component_id FROM r JOIN f ON f.fp = r.c GROUP BY 1)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN m USING (fp)
"""
