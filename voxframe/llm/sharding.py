"""Shards by extendible hashing: a directory of hash prefixes in which only oversized buckets are split on another bit.

Bytes are summed once per hash cell of a bounded depth; the directory follows from the sums of the cells'
prefixes. Only cells that are still too large are looked at more deeply. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .ranks import running_sum

HASH_BITS = 60
SHARD_BYTES = 16 << 20
SPARE_BITS = 4     # depth of the first cells beyond what equal buckets would need
DEEPER_BITS = 8


def hash_of(key: Column) -> Column:
    """The first 60 bits of the md5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(column: str, depth: Column | int) -> Column:
    return F.expr(f"shiftright({column}, CAST({HASH_BITS} - {depth} AS INT))")


def _directory(rows: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes, shard_rows, closed) for each cell of ``depth`` bits: the bucket that it belongs to.

    Buckets start at ``top`` bits. An open bucket is too large, has several hashes and reaches ``depth``.
    """
    cells = rows.groupBy(_prefix("hash", depth).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    lines = cells.select("*", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    buckets = lines.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"),
                                                   ((F.sum("bytes") > limit) & (F.min("low") < F.max("high"))).alias("split"))
    above = buckets.where("split").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    reached = (buckets.withColumn("parent", F.expr("shiftright(prefix, 1)")).join(above.withColumn("below", F.lit(True)), ["depth", "parent"], "left")
               .where((F.col("below") | (F.col("depth") == top)) & (~F.col("split") | (F.col("depth") == depth))))
    return lines.select("cell", "depth", "prefix").join(reached.select("depth", "prefix", "shard_bytes", "shard_rows", "split"), ["depth", "prefix"])


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: the key, bytes, depth, shard (its hash-prefix bits), page, shard_bytes, shard_rows.

    Every shard holds ``limit`` bytes at most, but for single rows that are larger. Rows of one key share a hash
    that no bit separates; where they exceed the limit they are cut into pages 0, 1, ... of the shard, and
    shard_bytes and shard_rows count the page. A null text has 0 bytes, a null key is a key; an empty table
    gives no rows; further columns are ignored.
    """
    sized = cut_lineage(docs.select(F.col(key).alias(key), hash_of(F.col(key)).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
                                    F.spark_partition_id().alias("part")))
    total = sized.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE_BITS)
    placed, rows, top = [], sized, 0
    while True:
        found = rows.withColumn("cell", _prefix("hash", depth)).join(cut_lineage(_directory(rows, top, depth, limit)), "cell").drop("cell")
        placed.append(found.where("NOT split"))
        pending = found.where("split").select(*sized.columns)
        if depth == HASH_BITS or pending.isEmpty():
            break
        rows, top, depth = cut_lineage(pending), depth, min(HASH_BITS, depth + DEEPER_BITS)
    shards = placed[0]
    for more in placed[1:]:
        shards = shards.unionByName(more)
    shards = shards.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))).drop("prefix", "split")
    columns = [key, "bytes", "depth", "shard", "page", "shard_bytes", "shard_rows"]
    whole = shards.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    crowded = shards.where(F.col("shard_bytes") > limit)
    if crowded.isEmpty():
        return whole.select(*columns)
    crowded = cut_lineage(crowded)
    largest = crowded.groupBy("hash").agg(F.max("bytes").alias("largest"))
    paged = (running_sum(crowded, ["hash"], "part", ["bytes"], F.col("bytes"), "before").join(largest, "hash")
             .withColumn("page", F.floor(F.col("before") / F.greatest(F.lit(1), limit - F.col("largest"))).cast("long")))
    paged = cut_lineage(paged.drop("shard_bytes", "shard_rows"))
    pages = paged.groupBy("hash", "page").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return whole.select(*columns).unionByName(paged.join(pages, ["hash", "page"]).select(*columns))


def sharding_sql(limit: int = SHARD_BYTES) -> str:
    """The same by recursion, for keys whose rows fit a shard."""
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
         CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) AS hash FROM documents),
buckets AS (
  SELECT d.depth, s.hash >> ({HASH_BITS} - d.depth) AS prefix, CAST(sum(s.bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows, min(s.hash) < max(s.hash) AS several
  FROM sized s, (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS depth) d GROUP BY 1, 2),
tree AS (
  SELECT depth, prefix, shard_bytes, shard_rows, several FROM buckets WHERE depth = 0
  UNION ALL
  SELECT b.depth, b.prefix, b.shard_bytes, b.shard_rows, b.several FROM tree t JOIN buckets b
  ON b.depth = t.depth + 1 AND b.prefix >> 1 = t.prefix WHERE t.shard_bytes > {limit} AND t.several)
SELECT s.doc_id, s.bytes, t.depth, CASE WHEN t.depth = 0 THEN '' ELSE right(lpad(CAST(CAST(t.prefix AS BIT) AS VARCHAR), 128, '0'), t.depth) END AS shard,
       CAST(0 AS BIGINT) AS page, t.shard_bytes, t.shard_rows
FROM sized s JOIN tree t ON s.hash >> ({HASH_BITS} - t.depth) = t.prefix WHERE NOT (t.shard_bytes > {limit} AND t.several)"""
