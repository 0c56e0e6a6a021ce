"""Merkle manifest of a dataset: the levels of aligned blocks as concatenated hex strings, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X

#: Hex digits of a node; a block holds 2**BITS neighbouring nodes of one level.
WIDTH, BITS = 64, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def leaf(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of the values one after another, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, node, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))


def siblings(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf's level to the root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, order: list[str], table) -> DataFrame:
    """rows with g, their place (from 0) in the given order; nulls first, strings bytewise, equal rows in any order.

    Rows are dealt by ranges of the order, so that no task gets a whole group, and of equal rows, too, as the row's number in
    its scan ends the order. Only the counts of the ranges, as many as partitions, go to the driver."""
    spark = rows.sparkSession
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    rows = table(rows.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    offsets, total = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("c")).collect()):
        offsets.append((r.part, total))
        total += r.c
    offsets = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    rows = rows.withColumn("part", part).join(offsets, "part", "left")
    return rows.withColumn("g", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")


def _block(held: list[str]) -> list[Column]:
    """Aggregates of a block's nodes: (levels, held). levels: each level's nodes as one hex string, up to the block's one
    node; a parent is the hash of a substring of two nodes, of one where the level ends."""
    x = F.array_sort(F.collect_list(F.struct("pos", "node", *held)))
    return [F.transform(x, lambda e: e["node"]).alias("nodes"), F.transform(x, lambda e: F.struct(*[e[c].alias(c) for c in held] or [F.lit(0).alias("none")])).alias("held")]


_PARENTS = f"array_join(transform(sequence(0, (length(element_at(up, -1)) - 1) div {2 * WIDTH}), j -> sha2(substring(element_at(up, -1), j * {2 * WIDTH} + 1, {2 * WIDTH}), 256)), '')"
#: Levels that a block climbs: up to its tree's root, BITS at most.
_HEIGHT = f"if(n = 1, 0, least({BITS}, length(bin(n - 1))))"
_LEVELS = f"if(n = 1, array(array_join(nodes, '')), aggregate(sequence(1, {_HEIGHT}), array(array_join(nodes, '')), (up, i) -> concat(up, array({_PARENTS}))))"
#: The siblings of the block's node k at each level but the top: flanking substrings, empty where there is none.
_FLANKS = (
    f"transform(slice(levels, 1, size(levels) - 1), (s, i) -> named_struct("
    f"'left', if(shiftright(k, i) % 2 = 1, substring(s, (shiftright(k, i) - 1) * {WIDTH} + 1, {WIDTH}), ''), "
    f"'right', if(shiftright(k, i) % 2 = 0, substring(s, (shiftright(k, i) + 1) * {WIDTH} + 1, {WIDTH}), '')))"
)


def climb(nodes: DataFrame, held: list[str], table, keep=None) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, roots) of nodes(tree, pos, n, node, *held), n being the nodes of the tree.

    A round is a table (tree, block, n, levels, held) of the blocks of one level in BITS; the blocks' own nodes are the next
    round's nodes, until each tree has one: roots (tree, node). keep writes the first round's table, table the others."""
    rounds: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        grouped = nodes.groupBy("tree", F.shiftright("pos", BITS).alias("block"), "n").agg(*_block(held))
        rounds.append((table if rounds or not keep else keep)(grouped.select("tree", "block", "n", F.expr(_LEVELS).alias("levels"), "held"), "blocks"))
        nodes, held = rounds[-1].select("tree", F.col("block").alias("pos"), F.shiftright(F.col("n") + ((1 << BITS) - 1), BITS).alias("n"), F.element_at("levels", -1).alias("node")), []
        most = (most + (1 << BITS) - 1) >> BITS
        if most == 1:
            return rounds, table(nodes.select("tree", "node"), "roots")


def _above(rounds: list[DataFrame], roots: DataFrame, table) -> DataFrame:
    """(tree, block, path) of every block of the first round: the siblings from its own node up, from roots(tree, path)."""
    above = roots.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for blocks in reversed(rounds[1:]):
        full = blocks.join(above, ["tree", "block"])
        each = F.expr(f"explode(transform(sequence(0, size(held) - 1), k -> named_struct('block', shiftleft(block, {BITS}) + k, 'path', concat({_FLANKS}, path))))")
        above = table(full.select("tree", each.alias("x")).select("tree", "x.block", "x.path"), "above")
    return above


def _trees(documents: DataFrame, fields, group: str, order: str, carry: dict[str, Column], table, keep):
    """(rounds of the groups' trees, table of groups with tree, subroot, root and path); keep writes what is read last."""
    own = {f"c{k}": v for k, v in enumerate(carry.values())}
    rows = documents.select(F.col(group).alias("grp"), F.col(order).alias("ord"), leaf(*[F.col(c) for c in fields]).alias("node"), *[v.alias(k) for k, v in own.items()])
    rows = numbered(table(rows, "leaves"), ["grp", "ord", "node"], table)
    groups = rows.groupBy("grp").agg(F.min("g").alias("first"), F.count("*").alias("n"))
    groups = table(numbered(groups, ["grp"], table).withColumnRenamed("g", "tree"), "groups")
    few = groups.count() <= X.BROADCAST_KEYS
    side = groups.select(F.col("grp").alias("name"), "first", "n", "tree")
    rows = rows.join(F.broadcast(side) if few else side, F.col("grp").eqNullSafe(F.col("name")))
    rounds, subroots = climb(rows.select("tree", (F.col("g") - F.col("first")).alias("pos"), "n", "node", "ord", *own), ["ord", *own], table, keep)
    top = subroots.join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(groups.count()).cast("long").alias("n"), "node", "grp", F.col("n").alias("leaves"))
    over, root = climb(top, ["grp", "leaves"], table)
    ends = _above(over, root.select("tree", F.lit([]).cast(PATH).alias("path")), table)
    each = F.expr(f"explode(transform(held, (e, k) -> named_struct('tree', shiftleft(block, {BITS}) + k, 'grp', e.grp, 'leaves', e.leaves, 'subroot', substring(levels[0], k * {WIDTH} + 1, {WIDTH}), 'path', concat({_FLANKS}, path))))")
    named = over[0].join(ends, ["tree", "block"]).select(each.alias("x")).select("x.*").crossJoin(F.broadcast(root.select(F.col("node").alias("root"))))
    return rounds, keep(named, "named")


def manifest(documents: DataFrame, fields=FIELDS, group: str = "lang", order: str = "doc_id") -> DataFrame:
    """(group, leaves, subroot, root): the Merkle root of each group of rows, and that of all groups in order.

    Rows, null values and ties are as in proofs(); an empty table has no groups."""
    with X.passing_tables(documents.sparkSession) as table:
        _, groups = _trees(documents, fields, group, order, {}, table, table)
        return X.table(groups.select(F.col("grp").alias(group), "leaves", "subroot", "root"), "manifest")


def proofs(documents: DataFrame, fields=FIELDS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, path, *carry), one row per row: its leaf and the siblings that lead from it to the root.

    Per group, leaves ascend by the order's column, null first; rows that share it ascend by leaf, and identical rows have
    neighbouring places. While a level has several nodes, every two consecutive ones become one, a last odd one becomes its
    own hash. The groups' roots, ordered by group, null first and bytewise, give the root in the same way. path has the
    sibling of each level, left or right of the leaf's own node, both empty where there is none. carry: further columns of
    the row to return, by name. Texts are read once and never shuffled; columns that aren't named take no part.

    An aligned block of 2**BITS nodes is one row, with each of its levels as one string of hex digits; blocks' own nodes are
    the nodes of the next round, 2**BITS times fewer. A group of any size is dealt by ranges. Paths are made as rows are
    read, and are never written. An empty table gives no rows.
    """
    carry = carry or {}
    with X.passing_tables(documents.sparkSession) as table:
        rounds, groups = _trees(documents, fields, group, order, carry, table, X.table)
        paths = X.table(_above(rounds, groups.select("tree", "path"), table), "paths")
    own = "".join(f", '{c}', e.{c}" for c in ["ord", *[f"c{k}" for k in range(len(carry))]])
    each = F.expr(f"explode(transform(held, (e, k) -> named_struct('leaf', substring(levels[0], k * {WIDTH} + 1, {WIDTH}), 'path', concat({_FLANKS}, path){own})))")
    rows = rounds[0].join(paths, ["tree", "block"]).select("tree", each.alias("x")).select("tree", "x.*")
    names = groups.select("tree", "subroot", "root")
    rows = rows.join(F.broadcast(names) if names.count() <= X.BROADCAST_KEYS else names, "tree")
    return rows.select(F.col("ord").alias(order), "leaf", "subroot", "root", "path", *[F.col(f"c{k}").alias(name) for k, name in enumerate(carry)])


def tampered() -> Column:
    """The leaf of a row whose n_chars is one more, where 7 divides the CRC-32 of its decimal doc_id; null elsewhere."""
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(*more))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry={"tampered": tampered()})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc32_sql(value: str) -> str:
    """DuckDB's CRC-32 of an ASCII string, in a query that also reads crc(t)."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(str_split({value}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


def _leaf_sql(*values: str) -> str:
    return "sha256(" + " || ".join(f"COALESCE(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


#: The same rows, level by level.
OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, {_leaf_sql(*FIELDS)} AS leaf, {_leaf_sql(*[c if c != "n_chars" else "(n_chars + 1)" for c in FIELDS])} AS other, DENSE_RANK() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
  ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, COUNT(*) OVER (PARTITION BY lang) AS n, {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AS bad FROM documents, crc),
l AS (SELECT tree, 0 AS level, pos, n, leaf AS node FROM d UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM l WHERE n > 1 GROUP BY tree, level, pos // 2, n),
s AS (SELECT tree AS pos, node, COUNT(*) OVER () AS n FROM l WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, node FROM s UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
p AS (SELECT d.tree, d.pos, l.level, l.pos AS sib, l.node FROM d JOIN l ON l.tree = d.tree AND l.n > 1 AND l.pos = xor(d.pos >> l.level, 1)
  UNION ALL SELECT d.tree, d.pos, 100 + u.level, u.pos, u.node FROM d JOIN u ON u.n > 1 AND u.pos = xor(d.tree >> u.level, 1)),
q AS (SELECT tree, pos, level, CASE WHEN sib % 2 = 0 THEN '<' ELSE '>' END || node AS step FROM p),
e AS (SELECT d.tree, d.pos, h.level, COALESCE(q.step, '') AS step FROM d JOIN (SELECT DISTINCT tree, level FROM l WHERE n > 1 UNION ALL SELECT a.tree, b.level + 100 FROM (SELECT DISTINCT tree FROM l) a, (SELECT DISTINCT level FROM u WHERE n > 1) b) h ON h.tree = d.tree
  LEFT JOIN q ON q.tree = d.tree AND q.pos = d.pos AND q.level = h.level),
f AS (SELECT tree, pos, list(step ORDER BY level) AS steps FROM e GROUP BY tree, pos),
g AS (SELECT d.*, COALESCE(steps, []) AS steps FROM d LEFT JOIN f ON f.tree = d.tree AND f.pos = d.pos),
r AS (SELECT node AS root FROM u WHERE n = 1),
o AS (SELECT doc_id, leaf, s.node AS subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN bad AND other IS NOT NULL THEN other ELSE leaf END, steps), lambda a, x: sha256(CASE WHEN x = '' THEN a WHEN x[1] = '<' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM g JOIN s ON s.pos = g.tree, r)
SELECT *, folded_root = root AS verified FROM o
"""
