"""A Merkle manifest of a table: one tree per language, one over their roots, and a proof for every row.

Leaves are numbered over the whole table by ranges. Hashes travel as 32 bytes and are digested as hex text. Levels are built in blocks of 2^STRIDE neighbours; every stored
node row links to its ancestor at the next stored level and holds the siblings on the way to it. A recursive query
climbs from each leaf along these links, appends the siblings and folds the hash of a row that may have been tampered with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .crc import crc32_ctes
from .ranks import number_rows
from .tables import store

STRIDE = 12       # binary levels between two stored levels
PAGE_BITS = 11    # nodes are stored once for each 2^PAGE_BITS leaves below them, so a join key serves no more
TOP = 1000        # stored levels from here on belong to the tree over the languages
END = -1          # the level of the root
TAMPER_EVERY = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT number, doc_id, leaf, 0 AS step, level, first, CAST(X'' AS BINARY) AS siblings, folded, subroot FROM {start}
  UNION ALL
  SELECT c.number, CAST(NULL AS BIGINT), CAST(NULL AS BINARY), c.step + 1, n.parent_level, n.parent_first,
         aggregate(n.path, CAST(X'' AS BINARY), (all, s) -> concat(all, s)),
         aggregate(n.path, named_struct('hash', c.folded, 'place', n.place), (h, s) -> named_struct(
           'hash', unhex(sha2(lower(hex(CASE WHEN h.place % 2 = 1 THEN concat(s, h.hash) ELSE concat(h.hash, s) END)), 256)),
           'place', shiftright(h.place, 1)), h -> h.hash),
         CASE WHEN n.tops THEN n.up END
  FROM climb c JOIN {nodes} n ON c.level = n.level AND c.first = n.first AND shiftright(c.number, {page_bits}) = n.page)
SELECT * FROM climb"""


def sized_text(value: Column) -> Column:
    """``-`` for null, else byte count, colon, text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hex_text(hash: Column) -> Column:
    return F.lower(F.hex(hash))


def leaf_hash(n_chars: Column) -> Column:
    columns = {c: F.col(c) for c in FIELDS} | {"n_chars": n_chars}
    return F.unhex(F.sha2(F.concat(*[sized_text(columns[c]) for c in FIELDS]), 256))


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % TAMPER_EVERY == 0, F.lit(False))


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their ``number`` in the order of language and doc_id, and languages with ``start``, ``n`` and ``place``.

    Ranges split languages and equal ids alike; the order of equal leaves does not matter.
    """
    leaves = store(docs.select("doc_id", "lang", leaf_hash(F.col("n_chars")).alias("leaf"),
                               F.when(is_tampered(F.col("doc_id")), leaf_hash(F.col("n_chars") + 1)).alias("tampered"),
                               F.monotonically_increasing_id().alias("uid")), "merkle-leaves")
    order = ["lang", "doc_id", "leaf", "uid"]
    ranged = store(leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("uid").withColumn("place", F.monotonically_increasing_id())
                   .withColumn("part", F.shiftright("place", 33).cast("int")).withColumn("place", F.expr("place & 8589934591")), "merkle-order")
    shares = ranged.groupBy("part", "lang").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    before = number_parts(ranged)
    spans = store(shares.join(before, "part").select("part", "lang", "n", "before", (F.col("before") + F.col("place")).alias("start")), "merkle-spans")
    languages = spans.groupBy("lang").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("part").alias("part"))
    placed = number_rows(store(languages, "merkle-languages"), [], "part", ["start"], "place").drop("part")
    placed = store(placed, "merkle-places")
    held = spans.alias("s").join(placed.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang"))).select(
        "s.part", F.col("s.lang").alias("span_lang"), "s.before", "l.start", F.col("l.n").alias("size"))
    same = (ranged["part"] == held["part"]) & ranged["lang"].eqNullSafe(held["span_lang"])  # no more rows than a range has
    rows = ranged.join(held, same).select("doc_id", "leaf", "tampered", (F.col("before") + F.col("place")).alias("number"), "start", "size")
    return store(rows, "merkle-numbered"), placed


def number_parts(ranged: DataFrame) -> DataFrame:
    """Rows before each range: one row per range."""
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    return counts.select("part", F.expr("coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("before"))


def _above(hashes: Column) -> Column:
    """The next binary level."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int")),
                       lambda i: F.sha2(F.concat(F.get(hashes, i * 2), F.coalesce(F.get(hashes, i * 2 + 1), F.lit(""))), 256))


def stored_level(nodes: DataFrame, level: int, after: int) -> DataFrame:
    """Node rows of one stored level.

    ``nodes``: tree, size (its nodes at this level), place (from 0, without gaps), hash, first, last (leaf numbers).
    Trees of one node give no rows. A row's ``path`` holds its siblings, empty where there is none; the bits of its place
    tell their sides. ``up`` is the hash of its parent, ``tops`` says that the parent is the root
    of the tree, which continues at level ``after``. A block has 2^STRIDE nodes at most.
    """
    whole = 1 << STRIDE
    blocks = nodes.where("size > 1").groupBy("tree", "size", F.shiftright("place", STRIDE).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "hash", "first", "last"))).alias("cells"))
    blocks = blocks.withColumn("levels", F.least(F.lit(STRIDE), F.length(F.bin(F.col("size") - 1))).cast("int"))
    ladder = F.aggregate(F.sequence(F.lit(1), F.col("levels")), F.array(F.transform("cells", lambda c: hex_text(c["hash"]))),
                         lambda done, _: F.concat(done, F.array(_above(F.element_at(done, -1)))))

    def step(built: Column, i: Column, k: Column) -> Column:
        place = F.call_function("shiftright", i, k)
        beside = F.get(F.get(built, k), F.when(place % 2 == 1, place - 1).otherwise(place + 1))
        return F.unhex(F.coalesce(beside, F.lit("")))

    def rows(built: Column) -> Column:
        return F.transform("cells", lambda c, i: F.struct(
            c["place"].alias("place"), c["first"].alias("first"), c["last"].alias("last"),
            F.transform(F.sequence(F.lit(0), F.col("levels") - 1), lambda k: step(built, i, k)).alias("path"),
            F.unhex(F.get(F.element_at(built, -1), F.lit(0))).alias("up")))

    bound = F.get(F.transform(F.array(ladder), rows), F.lit(0))  # the ladder is computed once per block
    opened = blocks.select("tree", "size", F.get("cells", F.lit(0))["first"].alias("parent_first"), F.element_at("cells", -1)["last"].alias("parent_last"),
                           F.explode(bound).alias("r")).select("tree", "size", "parent_first", "parent_last", "r.*")
    tops = F.col("size") <= whole
    return opened.withColumn("tops", tops).withColumn("level", F.lit(level)).withColumn("parent_level", F.when(tops, after).otherwise(level + 1)).withColumn(
        "page", F.explode(F.sequence(F.shiftright("first", PAGE_BITS), F.shiftright("last", PAGE_BITS))))


def _tree(nodes: DataFrame, level: int, after: int, largest: int) -> list[DataFrame]:
    """Stored levels up to the roots of all trees; ``largest`` is the number of nodes of the largest one."""
    out, whole = [], 1 << STRIDE
    while largest > 1:
        stored = store(stored_level(nodes, level, after), f"merkle-level-{level}")
        out.append(stored)
        first_page = F.col("page") == F.shiftright("first", PAGE_BITS)
        nodes = stored.where(first_page & (F.col("place") % whole == 0) & ~F.col("tops")).select(
            "tree", F.ceil(F.col("size") / whole).cast("long").alias("size"), F.shiftright("place", STRIDE).alias("place"),
            F.col("up").alias("hash"), F.col("parent_first").alias("first"), F.col("parent_last").alias("last"))
        largest, level = -(-largest // whole), level + 1
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``.

    The proof and the hashes come from the rows as they stand; the climb starts from the tampered leaf where 7 divides
    the CRC-32 of the decimal doc_id (1 more in ``n_chars``, nulls stay).

    Rows are ordered by language (null first, bytewise), doc_id (null first) and leaf, so repeated rows and equal ids
    have defined places; a null in any column is hashed as ``-``; a null doc_id is never tampered with. Texts of any
    length are hashed where they are read and go no further. Further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows, languages = _numbered(docs.select(*[F.col(c) for c in FIELDS]))
    total = languages.agg(F.count("*").alias("n"), F.max("n").alias("largest")).first()
    if not total["n"]:
        return _empty(docs)
    after = TOP if total["n"] > 1 else END
    leaves = rows.select(F.col("start").alias("tree"), "size", (F.col("number") - F.col("start")).alias("place"), F.col("leaf").alias("hash"),
                         F.col("number").alias("first"), F.col("number").alias("last"))
    levels = _tree(leaves, 0, after, total["largest"])

    single = rows.where("size = 1").select(F.col("number").alias("tree"), F.col("leaf").alias("hash"))
    roots = single
    for stored in levels:
        roots = roots.unionByName(stored.where("tops AND place = 0 AND first = tree").where(F.col("page") == F.shiftright("tree", PAGE_BITS)).select("tree", F.col("up").alias("hash")))
    roots = languages.join(roots.withColumnRenamed("tree", "start"), "start").select(
        F.lit(-1).cast("long").alias("tree"), F.lit(total["n"]).cast("long").alias("size"), "place", "hash", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
    roots = store(roots, "merkle-roots")
    levels += _tree(roots, TOP, END, total["n"])
    root = (roots.select(hex_text(F.col("hash"))) if total["n"] == 1 else levels[-1].where("tops AND place = 0").select(hex_text(F.col("up")))).first()[0]

    nodes = None
    for stored in levels:
        part = stored.select("level", "first", "page", "place", "path", "up", (F.col("tops") & (F.col("level") < TOP)).alias("tops"), "parent_level", "parent_first")
        nodes = part if nodes is None else nodes.unionByName(part)
    start = rows.select("number", F.col("doc_id").cast("long").alias("doc_id"), "leaf", F.when(F.col("size") > 1, 0).otherwise(after).alias("level"),
                        F.col("number").alias("first"), F.coalesce("tampered", "leaf").alias("folded"), F.when(F.col("size") == 1, F.col("leaf")).alias("subroot"))
    if nodes is None:
        return _verdicts(start.withColumns({"step": F.lit(0), "siblings": F.unhex(F.lit(""))}), root)
    return _climb(spark, start, nodes, root)


def _climb(spark: SparkSession, start: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """All climbs and what they end in. The session's limit on the rows of a recursion is lifted while they are computed."""
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return store(_verdicts(spark.sql(CLIMB, start=start, nodes=nodes, page_bits=PAGE_BITS), root), "merkle-proofs")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def _verdicts(climbed: DataFrame, root: str) -> DataFrame:
    """One row per leaf from one row per stored level."""
    steps = F.sort_array(F.collect_list(F.struct("step", "siblings")))
    return (climbed.groupBy("number").agg(F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"), F.max("subroot").alias("subroot"),
                                          F.max_by("folded", "step").alias("folded"), steps.alias("steps"))
            .select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"),
                    F.sha2(F.array_join(F.transform("steps", lambda s: hex_text(s["siblings"])), ""), 256).alias("proof_sha256"),
                    hex_text(F.col("folded")).alias("folded_root"), (hex_text(F.col("folded")) == root).alias("verified")))


def _empty(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest_sql() -> str:
    """The same level by level."""
    text = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda chars: "sha256(" + " || ".join(text(chars if c == "n_chars" else c) for c in FIELDS) + ")"
    levels = lambda name, source, key: f"""
{name} AS (
  SELECT {key}, 0 AS level, place, count(*) OVER (PARTITION BY {key}) AS size, hash FROM {source}
  UNION ALL
  SELECT {key}, level + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(hash, '' ORDER BY place)) FROM {name} WHERE size > 1
  GROUP BY {key}, level, place // 2)"""  # noqa: E731
    climbs = lambda name, source, tree, key: f"""
{name} AS (
  SELECT uid, {key}, 0 AS level, place, folded, proof FROM {source}
  UNION ALL
  SELECT c.uid, c.{key}, c.level + 1, c.place // 2,
         sha256(CASE WHEN c.place % 2 = 1 THEN s.hash || c.folded ELSE c.folded || coalesce(s.hash, '') END), c.proof || coalesce(s.hash, '')
  FROM {name} c JOIN {tree} t ON t.{key} = c.{key} AND t.level = c.level AND t.place = c.place AND t.size > 1
  LEFT JOIN {tree} s ON s.{key} = c.{key} AND s.level = c.level AND s.place = xor(c.place, 1))"""  # noqa: E731
    return f"""
WITH RECURSIVE {crc32_ctes('SELECT DISTINCT doc_id AS id FROM documents').strip()},
hashed AS (
  SELECT row_number() OVER () AS uid, d.doc_id, d.lang, {leaf('n_chars')} AS hash,
         CASE WHEN c.crc % {TAMPER_EVERY} = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS folded
  FROM documents d LEFT JOIN crcs c ON c.id = d.doc_id),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, hash) - 1 AS place FROM hashed),
{levels('nodes', 'leaves', 'tree')},
subroots AS (SELECT 0 AS forest, tree AS place, hash FROM nodes WHERE size = 1),
{levels('upper', 'subroots', 'forest')},
starts AS (SELECT uid, tree, place, folded, '' AS proof FROM leaves),
{climbs('climb', 'starts', 'nodes', 'tree')},
halfway AS (
  SELECT c.uid, 0 AS forest, c.tree AS place, c.folded, c.proof FROM climb c JOIN nodes t ON t.tree = c.tree AND t.level = c.level AND t.size = 1),
{climbs('last', 'halfway', 'upper', 'forest')},
root AS (SELECT level, hash FROM upper WHERE size = 1)
SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, r.hash AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.hash AS verified
FROM leaves l JOIN last c ON c.uid = l.uid JOIN root r ON c.level = r.level JOIN subroots s ON s.place = l.tree"""
