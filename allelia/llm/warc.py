"""WARC archives: writing with revisit records, and reading by boundary-chain verification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as X

#: Every record starts with this; readers split the files at it, whatever stands around it.
MAGIC = "WARC/1."
END = "\r\n\r\n"
#: Digests of repeated payloads that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four characters."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header_value(c: Column) -> Column:
    """Without line breaks and without the magic, so that a header is one fragment."""
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", "%0A"), F.lit(MAGIC), F.lit("WARC%2F1."))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages(page_id, url, html) as WARC files, one a task: one record a row.

    Of rows with equal payloads (html in UTF-8, null as empty) of at least least_bytes, the smallest page_id has the
    payload in a response; the others are revisits without a block. Rows that repeat the smallest page_id are all
    responses. A null page_id has an empty id in its record. Payloads move between machines only if over BROADCAST_ROWS
    of them repeat.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html")))
    big = F.octet_length("html") >= least_bytes
    repeats = rows.where(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    repeats = X.table(repeats, "repeats")
    few = repeats.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(repeats) if few else repeats, "digest", "left")
    again = F.coalesce(F.col("first").isNotNull() & big & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        (F.lit("WARC-Type"), F.when(again, "revisit").otherwise("response")),
        (F.lit("WARC-Record-ID"), identity(F.col("page_id"))),
        (F.lit("WARC-Date"), F.lit(date)),
        (F.lit("WARC-Target-URI"), _header_value(F.col("url"))),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), F.col("digest"))),
        (F.when(again, "WARC-Refers-To"), identity(F.col("first"))),
        (F.when(again, "WARC-Profile"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        (F.lit("Content-Type"), F.lit("text/html")),
        (F.lit("Content-Length"), F.when(again, F.lit(0)).otherwise(F.octet_length("html")).cast("string")),
    ]
    # concat of a missing name is null, and concat_ws leaves it out
    head = F.concat_ws("\r\n", F.lit(MAGIC + "1"), *[F.concat(name, F.lit(": "), value) for name, value in lines])
    record = F.concat(head, F.lit(END), F.when(again, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every MAGIC: (file, block, at, value), at counting a block's fragments in reading order."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For a block's candidates: where their chain leaves the block; -1 if it breaks inside."""
    rows = rows.sort_values("offset")
    end = int(rows["block_end"].iloc[0])
    leave: dict[int, int] = {}
    for offset, after in zip(rows["offset"].tolist()[::-1], rows["after"].tolist()[::-1]):
        leave[offset] = after if after >= end else leave.get(after, -1)
    return rows.assign(leave=rows["offset"].map(leave))[["file", "block", "offset", "leave"]]


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its entries reach."""
    after = {o: a for o, a, e in zip(rows["offset"].tolist(), rows["after"].tolist(), rows["entry"].tolist())}
    kept = set()
    for offset in rows.loc[rows["entry"], "offset"].tolist():
        while offset in after and offset not in kept:
            kept.add(offset)
            offset = after[offset]
    return rows[rows["offset"].isin(kept)][["file", "block", "offset"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """Of candidates(file, block, block_end, offset, after): those on the chain of records from offset 0 of their file.

    Each block's task follows its own candidates to where they leave the block. Between blocks, pointers jump: the
    entries reached double their stride each round, so files of n blocks take log2(n) rounds. Only offsets move.
    """
    exits = X.table(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, block long, offset long, leave long"), "exits")
    entries = exits.select("file", F.col("leave").alias("offset")).where("offset > 0").distinct()
    jump = X.table(exits.join(entries, ["file", "offset"], "left_semi").unionAll(exits.where("offset = 0")).select("file", "offset", F.col("leave").alias("to")).distinct(), "jumps")
    reach = X.table(jump.where("offset = 0").select("file", "offset"), "reached")
    n = reach.count()
    while True:
        more = reach.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reach = X.table(reach.unionAll(more).distinct(), "reached")
        now = reach.count()
        if now == n:
            break
        n = now
        step = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("far"))
        jump = X.table(jump.join(step, ["file", "to"]).select("file", "offset", F.col("far").alias("to")), "jumps")
    marked = candidates.join(reach.withColumn("hit", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("hit", F.lit(False)))
    return marked.groupBy("file", "block").applyInPandas(_chain, "file string, block long, offset long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, page_id, url, refers_to, header_digest, payload_bytes, payload_digest) of the records below path.

    Files are read in blocks of any size, cut at every MAGIC. A fragment whose header is whole is a candidate record with
    its successor's offset; only those on the chain from their file's start are records, so a MAGIC inside a payload,
    even with a whole record around it, is none. A record's bytes and digest come from its payload as stored; the
    payload of a record that holds a MAGIC is put together again from its fragments in a second reading, whose splits are held
    to those of the first. Chains that break end there.
    """
    n = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    with X.setting(spark, "spark.sql.files.minPartitionNum", str(n)):
        return X.table(_records(spark, path), "records")


def _records(spark: SparkSession, path: str) -> DataFrame:
    value, cut = F.col("value"), F.col("size")
    head = F.substring_index(value, END, 1)
    get = lambda name: F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    info = _fragments(spark, path).withColumns({"size": F.octet_length("value"), "head": F.when(F.contains(value, F.lit(END)), head)})
    info = info.withColumns({"start": F.octet_length("head") + 4, "length": F.expr(r"try_cast(regexp_extract(head, '(?i)\r\nContent-Length:[ \t]*([0-9]+)', 1) as long)")})
    body = F.expr("substring(cast(value as binary), start + 1, length)")
    whole = cut == F.col("start") + F.col("length") + 4
    last = F.expr("octet_length(value) >= start + length")
    info = info.select(
        "file", "block", "at", "size", "start", "length", get("WARC-Type").alias("record_type"),
        F.expr("try_cast(regexp_extract(head, '(?i)\\r\\nWARC-Record-ID:[ \\t]*<urn:page:(-?[0-9]+)>', 1) as long)").alias("page_id"),
        F.expr("try_cast(regexp_extract(head, '(?i)\\r\\nWARC-Refers-To:[ \\t]*<urn:page:(-?[0-9]+)>', 1) as long)").alias("refers_to"),
        get("WARC-Target-URI").alias("url"), F.regexp_extract("head", r"(?i)\r\nWARC-Payload-Digest:[ \t]*sha1:([A-Z2-7]+)", 1).alias("header_digest"),
        F.when(whole | last, base32_sha1(body)).alias("payload_digest"),
    )
    info = X.table(info, "fragments")
    order = Window.partitionBy("file", "block").orderBy("at")
    step = F.col("size") + len(MAGIC)
    blocks = info.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    blocks = blocks.withColumn("base", F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes") - len(MAGIC))
    placed = info.withColumns({"index": F.row_number().over(order), "before": F.sum(step).over(order) - step}).join(blocks, ["file", "block"])
    placed = placed.withColumn("offset", F.col("base") + F.col("before"))
    candidates = placed.where("offset >= 0 AND length IS NOT NULL").select(
        "file", "block", "offset", (F.col("base") + F.col("bytes")).alias("block_end"), (F.col("offset") + len(MAGIC) + F.col("start") + F.col("length") + 4).alias("after")
    )
    found = placed.join(reachable(X.table(candidates, "candidates")), ["file", "block", "offset"], "left_semi")
    found = X.table(found.select("file", "offset", "start", "length", "record_type", "page_id", "refers_to", "url", "header_digest", "payload_digest"), "records")
    split = found.where("payload_digest IS NULL")
    if split.limit(1).count():
        again = _fragments(spark, path).withColumn("index", F.row_number().over(order)).drop("at")
        pieces = again.join(placed.select("file", "block", "index", "offset"), ["file", "block", "index"])
        # fragments belong to the last record that starts at or before them
        starts = found.select("file", "offset", F.col("offset").alias("record"))
        owner = placed.select("file", "offset").join(starts, ["file", "offset"], "left")
        owner = owner.withColumn("record", F.last("record", True).over(Window.partitionBy("file").orderBy("offset")))
        owner = owner.join(split.select("file", F.col("offset").alias("record")), ["file", "record"])
        joined = pieces.join(owner, ["file", "offset"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
        joined = joined.select("file", F.col("record").alias("offset"), F.array_join("parts.value", MAGIC).alias("value"))
        joined = joined.join(split.select("file", "offset", "start", "length"), ["file", "offset"]).select("file", "offset", base32_sha1(body).alias("put_together"))
        found = found.join(joined, ["file", "offset"], "left").withColumn("payload_digest", F.coalesce("payload_digest", "put_together"))
    return found.select("record_type", "page_id", "url", "refers_to", "header_digest", F.col("length").alias("payload_bytes"), "payload_digest")


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), revisits with the payload of what they refer to."""
    revisit = F.col("record_type") == "revisit"
    full = records.where(~revisit).groupBy(F.col("payload_digest").alias("header_digest")).agg(F.max("payload_bytes").alias("full_bytes"))
    first = records.where(~revisit).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    rest = records.where(revisit).join(full, "header_digest", "left").select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), "record_type", "refers_to")
    return first.unionAll(rest)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = X.scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return pages_of(read_archives(spark, path))


#: The same rows without archives.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, h FROM p),
b AS (SELECT page_id, payload_bytes, translate(string_agg(lpad(to_base(CAST('0x' || substr(s, 5 * i + 1, 5) AS BIGINT), 32), 4, '0'), '' ORDER BY i),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM d, range(8) AS r(i) GROUP BY page_id, payload_bytes, s),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
