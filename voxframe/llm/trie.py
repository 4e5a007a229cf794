"""The prefix trie of conversations, from vertical bitmaps.

Each shard is a range of SHARD_IDS conversation ids. In it, (position, turn) is indexed to the bitset of the ids that have this
turn there. Walking depth-first, the bitset of a node is intersected with the postings of the next position: the results are
its children, their bits the members, and the members of that length end there. Nodes of different shards that stand for the
same turns share a key, a digest chained along the path, under which Spark merges them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .crc import crc32_ctes
from .tables import store

SHARD_BITS = 10
SHARD_IDS = 1 << SHARD_BITS
GROUP = 5            # a conversation borrows from the one whose id its own is cut down to, by this modulus
MAX_BORROWED = 8     # h is a remainder modulo one more
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = pa.schema([("shard", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("last_bytes", pa.int64()), ("conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("ends", pa.string()), ("place", pa.int64()), ("above", pa.int64()), ("after", pa.int64())])
NODES_DDL = "shard long, key binary, parent binary, depth long, last_bytes long, conv_id long, n_convs long, ends string, place long, above long, after long"
SUMS_DDL = "key binary, parent_conv_id long, n_leaves long, saved_tokens long"


def borrowed(conv_id: Column) -> Column:
    """h, the number of turns taken from the base conversation."""
    return F.crc32(conv_id.cast("string")) % (MAX_BORROWED + 1)


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for (role, text); null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, n_bytes) of all rebuilt conversations, in the order of ``place``, and one row without a digest for each.

    Texts are digested where they are read, so only digests are shuffled. Turns are ordered by turn (null first), then
    by digest. c - c % 5 is the remainder of SQL, towards zero. Rows without conv_id belong to no conversation.
    """
    digested = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = store(digested.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "digest", "n_bytes"), "trie-turns")
    base, h = F.col("conv_id") - F.col("conv_id") % GROUP, borrowed(F.col("conv_id"))
    own = rows.where((F.col("place") >= h) | (base == F.col("conv_id")))
    convs = rows.where("place = 0").select("conv_id", base.alias("base"), h.alias("h"))  # every conversation once
    heads = rows.where(F.col("conv_id") == base).where(F.col("place") < MAX_BORROWED).select(F.col("conv_id").alias("base"), "place", "digest", "n_bytes")
    taken = convs.where("conv_id <> base").join(heads, "base").where("place < h").select("conv_id", "place", "digest", "n_bytes")
    marks = convs.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    return own.unionByName(taken).unionByName(marks)


def shard_nodes(shard: int, turns: dict[int, list[tuple[bytes, int]]]) -> Iterator[tuple]:
    """The nodes of one shard in depth-first order: shard, key, parent key, depth, bytes of the last text, smallest member, members, ends, place, parent's place.

    ``turns`` lists (digest, bytes) by conversation id.
    """
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    lengths: dict[int, int] = defaultdict(int)
    first_id = shard << SHARD_BITS
    for number, path in turns.items():
        bit = 1 << (number - first_id)
        lengths[len(path)] |= bit
        for position, (digest, _) in enumerate(path):
            postings[position, digest] |= bit
    place, stack = 0, [(sum(1 << (n - first_id) for n in turns), 0, ROOT, None, 0, -1)]
    while stack:
        members, depth, key, parent, last_bytes, above = stack.pop()
        here = members & lengths.get(depth, 0)
        ends = []
        while here:
            low = here & -here
            ends.append(str(first_id + low.bit_length() - 1))
            here ^= low
        smallest = first_id + (members & -members).bit_length() - 1
        yield shard, key, parent, depth, last_bytes, smallest, members.bit_count(), ",".join(ends) if ends else None, place, above
        rest = members & ~lengths.get(depth, 0)
        while rest:
            digest, size = turns[first_id + (rest & -rest).bit_length() - 1][depth]
            child = rest & postings[depth, digest]  # ids of the parent that go on with this turn
            rest ^= child
            stack.append((child, depth + 1, hashlib.md5(key + digest).digest(), key, size, place))
        place += 1


def _walk(table: pa.Table) -> pa.Table:
    shard = table["shard"][0].as_py()
    ordered = table.sort_by([("conv_id", "ascending"), ("place", "ascending")])
    turns: dict[int, list[tuple[bytes, int]]] = {}
    for number, digest, size in zip(ordered["conv_id"].to_pylist(), ordered["digest"].to_pylist(), ordered["n_bytes"].to_pylist()):
        path = turns.setdefault(number, [])
        if digest is not None:
            path.append((digest, size))
    columns = list(zip(*shard_nodes(shard, turns)))
    above = columns[-1]
    size = [1] * len(above)
    for at in range(len(above) - 1, 0, -1):  # children stand after their parents
        size[above[at]] += size[at]
    after = [at + n for at, n in enumerate(size)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, after], NODES)], schema=NODES)


def _sum_subtrees(table: pa.Table) -> pa.Table:
    """Sums over the subtrees of a shard's nodes, in which a node counts where its smallest member lives."""
    ordered = table.sort_by([("place", "ascending")])
    column = lambda name: ordered[name].to_numpy()
    mine = column("conv_id") >> SHARD_BITS == column("shard")
    before = lambda values: np.concatenate(([0], np.cumsum(np.where(mine, values, 0), dtype=np.int64)))
    start, after = column("place"), column("after")
    leaves, saved = before(column("n_children") == 0), before((column("n_convs") - 1) * column("last_bytes"))
    above = column("above")
    parent = pa.array(column("conv_id")[np.maximum(above, 0)], pa.int64(), mask=above < 0)
    return pa.table({"key": ordered["key"], "parent_conv_id": parent, "n_leaves": leaves[after] - leaves[start], "saved_tokens": saved[after] - saved[start]})


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key of rows ordered by key and shard: the lists pass through it one after the other and are never held together."""
    key, running = None, None
    for batch in batches:
        keys, digests = [], []
        for found, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if found != key:
                if running:
                    keys.append(key)
                    digests.append(running.hexdigest())
                key, running = found, hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; see ``rebuild``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, a null turn comes first, rows without conv_id are left out, ties of turn are ordered
    by digest and repeated rows are turns of their own. Texts of any length pass as digests; a conversation has to fit a
    task at about 50 bytes a turn. Further columns are ignored; an empty table gives no rows.
    """
    rebuilt = rebuild(turns).withColumn("shard", F.shiftright("conv_id", SHARD_BITS))
    found = store(rebuilt.groupBy("shard").applyInArrow(_walk, NODES_DDL), "trie-shards")
    merged = store(found.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("depth").alias("depth"),
                                            F.max("parent").alias("parent"), F.max("last_bytes").alias("last_bytes")), "trie-merged")
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = store(merged.join(children, "key", "left").select("key", "conv_id", "n_convs", "depth", "last_bytes", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "trie-nodes")
    # One row per shard and node on the left, one per node on the right.
    local = found.select("shard", "key", "place", "above", "after").join(nodes.select("key", "conv_id", "n_convs", "last_bytes", "n_children"), "key")
    sums = (local.groupBy("shard").applyInArrow(_sum_subtrees, SUMS_DDL)
            .groupBy("key").agg(F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    ends = (found.where("ends IS NOT NULL").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
            .mapInArrow(_digest_lists, "key binary, ends_sha256 string"))
    return nodes.join(sums, "key").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def trie_sql() -> str:
    """The same from lists of turn digests."""
    return f"""
WITH RECURSIVE {crc32_ctes('SELECT DISTINCT conv_id AS id FROM conversations').strip()},
turns AS (
  SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS n_bytes, turn
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, digest, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM turns),
convs AS (SELECT id AS conv_id, id - id % {GROUP} AS base, crc % {MAX_BORROWED + 1} AS h FROM crcs),
rebuilt AS (
  SELECT c.conv_id, p.place, p.digest, p.n_bytes FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place < c.h
  UNION ALL
  SELECT c.conv_id, p.place, p.digest, p.n_bytes FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place >= c.h),
paths AS (
  SELECT c.conv_id, coalesce(list(r.digest ORDER BY r.place) FILTER (r.digest IS NOT NULL), []) AS path, coalesce(list(r.n_bytes ORDER BY r.place) FILTER (r.digest IS NOT NULL), []) AS sizes
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d.depth, len(path) AS length, path[1:d.depth] AS prefix, sizes[d.depth] AS last_bytes FROM paths, (SELECT unnest(range(0, (SELECT max(len(path)) + 1 FROM paths))) AS depth) d WHERE d.depth <= len(path)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(last_bytes) AS last_bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth),
kin AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kin k ON k.prefix = n.prefix AND k.depth = n.depth),
sums AS (
  SELECT n.prefix[1:d.depth] AS prefix, d.depth, count(*) FILTER (n.n_children = 0) AS n_leaves, CAST(sum((n.n_convs - 1) * coalesce(n.last_bytes, 0)) AS BIGINT) AS saved_tokens
  FROM full_nodes n, (SELECT unnest(range(0, (SELECT max(depth) + 1 FROM nodes))) AS depth) d WHERE d.depth <= n.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.prefix = n.prefix AND s.depth = n.depth
LEFT JOIN full_nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1] AND p.depth = n.depth - 1"""
