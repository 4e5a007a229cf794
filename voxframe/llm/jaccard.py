"""Jaccard join of word shingles by token-combination prefixes.

Tokens (64-bit shingle hashes) have one global order: rare before frequent, then by hash. A set of n tokens
may miss e = n - ceil(t n) of them in a partner, so two linked sets share a token among the first e + 1 of
each. A token found in more than ``frequent`` windows (the first tokens of a set by hash) is frequent.

* A set whose window holds e + 1 rare tokens indexes these as single tokens.
* A set made mostly of frequent tokens extends its prefix to all its tokens and indexes combinations of k
  tokens: tokens are dealt to P hash cells in groups of four; a partner differs in at most D < 3P/4 cells, so
  some group has two equal cells, and every pair of cells in a group is one combination.
* Between the two kinds, the first e + 1 tokens by hash alone are compared.

Candidates pass a size bound and a parity bitmap bound inside the join, then whole sets are compared.
Equal sets are one node. To keep large groups from being paired off, the members of an index entry are first
compared with one of them only, in a few rounds; what that connects needs no further comparison, and then all
pairs of an entry that are still in different components are compared. No link between different components
is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.components import contract_edges
from .tables import drop_scratch, store

FREQUENT = 32
BROADCAST_ROWS = 200_000
BAND = 1.25
STAR_ROUNDS = 3
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one-to-one)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; shorter texts are one shingle, texts without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + len(out)])
    found = np.sort(out.view(np.int64))
    return found[np.append(True, found[1:] != found[:-1])]


def allowed_misses(n, percent: int):
    """How many of n tokens a linked set may lack."""
    return n - -(-percent * n // 100)


def bitmap_words(n: int, percent: int) -> int:
    """64-bit words of the parity bitmap of a set of n tokens; a power of two, growing with n."""
    return 1 << max(0, (4 * n * (100 - percent) // (64 * percent)).bit_length())


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    """Parity of the number of tokens on each bit: sets differ in as many tokens as bits differ, or more."""
    bits = np.bincount((tokens.view(np.uint64) & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, tkey, row, n, key (digest of the set), window and bits, for every row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                n, keys, windows, bits = [], [], [], []
                for text in some.column("text"):
                    tokens = shingle_hashes(text.as_py(), width)
                    misses = allowed_misses(len(tokens), percent)
                    n.append(len(tokens))
                    keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                    windows.append(tokens[:misses + 1 + max(8, misses // 8)])
                    bits.append(bitmap(tokens, bitmap_words(len(tokens), percent)))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("tkey"), some.column("row"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                     _lists(windows), _lists(bits)], names=["doc_id", "tkey", "row", "n", "key", "window", "bits"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(sets, "doc_id long, tkey long, row long, n long, key binary, window array<long>, bits array<long>")


def cell_signatures(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Combination signatures of a set for the size bands in which it may be the smaller partner, or the larger."""
    n = len(tokens)
    low = -(-percent * n // 100)
    bands = {int(np.floor(np.log(m) / np.log(BAND))) for m in (low, n)} if n else set()
    out = []
    for band in range(min(bands), max(bands) + 1) if bands else ():
        most = int(BAND ** (band + 1)) + 1                       # no set of the band has more tokens
        differ = most * (100 - percent) // percent
        cells = 4 * (differ // 3 + 1)                            # above 4/3 of the tokens that may differ
        spread = mix(tokens.view(np.uint64) + np.uint64(band + 1))
        held = np.zeros(cells, np.uint64)
        np.add.at(held, (spread % np.uint64(cells)).astype(np.int64), mix(spread + np.uint64(7)))
        group = held.reshape(-1, 4)
        number = np.arange(len(group), dtype=np.uint64)
        for i in range(4):
            for j in range(i + 1, 4):
                seed = mix(np.full(len(group), (band * 16 + i * 4 + j) * 1_000_003 + 17, np.uint64))
                out.append(mix(mix(mix(number + seed) + group[:, i]) * np.uint64(3) + group[:, j]))
    return np.unique(np.concatenate(out).view(np.int64)) if out else np.zeros(0, np.int64)


def _compatible(a: str, b: str, percent: int) -> Column:
    """Could the sets of aliases a and b link? By their sizes and bitmaps; never refuses a link."""
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(a, "n") + c(b, "n")
    sizes = (F.least(c(a, "n"), c(b, "n")) * 100 >= percent * F.greatest(c(a, "n"), c(b, "n")))
    most = total - 2 * F.ceil(percent * total / (100 + percent))
    wide, narrow = F.size(c(a, "bits")), F.size(c(b, "bits"))
    folded = lambda bits: F.zip_with(F.slice(bits, F.lit(1), F.greatest(F.lit(1), F.size(bits) / 2).cast("int")),
                                     F.slice(bits, (F.size(bits) / 2).cast("int") + 1, F.size(bits)), lambda x, y: x.bitwiseXOR(y))
    left = F.when(wide > narrow, folded(c(a, "bits"))).otherwise(c(a, "bits"))
    right = F.when(narrow > wide, folded(c(b, "bits"))).otherwise(c(b, "bits"))
    differ = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return sizes & (differ <= most)


def rare_places(entries: Column) -> Column:
    """The rare tokens of a window and their places among its rare ones: the position less the frequent tokens before it.

    Those are the entries before a token (``pos, token, often``, sorted by position) that are not rare; unshared tokens have no entry.
    """
    numbered = F.transform(entries, lambda x, nth: F.struct(x["token"].alias("sig"), x["pos"].alias("pos"), x["often"].alias("often"), nth.alias("nth")))
    rare = F.filter(numbered, lambda x: ~x["often"])
    return F.transform(rare, lambda x, before: F.struct(x["sig"].alias("sig"), (x["pos"] - (x["nth"] - before)).alias("place")))


def _token_sets(docs: DataFrame, nodes: DataFrame, width: int, name: str = "tokens", made: Callable[[np.ndarray], np.ndarray] = lambda tokens: tokens) -> DataFrame:
    """(node, ``name``) of the given nodes (node, doc_id, tkey): ``made`` of their tokens, cut from their texts again.

    What is made of tokens is made here: a Python step on top would keep a second worker per core, with its memory, for good.
    """
    few = nodes.count() <= BROADCAST_ROWS
    wanted = nodes.select("node", F.col("doc_id").alias("w_doc"), F.col("tkey").alias("w_key"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey")).join(
        F.broadcast(wanted) if few else wanted, (F.col("tkey") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_doc")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            fresh = []                                 # repeated rows are cut once in a task
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in done:
                    done.add(node)
                    fresh.append(i)
            for low in range(0, len(fresh), 128):
                some = batch.take(pa.array(fresh[low:low + 128]))
                yield pa.RecordBatch.from_arrays([some.column(0), _lists([made(shingle_hashes(t.as_py(), width)) for t in some.column(1)])], names=["node", name])

    return texts.select("node", "text").mapInArrow(cut, f"node long, {name} array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """The (u, v) pairs that link, by their whole sets."""
    pairs = store(pairs, "pairs")
    named = store(nodes.select("node", "doc_id", "tkey").join(
        pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct(), "node"), "named")
    sets = store(_token_sets(docs, named, width), "sets")
    if sets.count() > named.count():                   # rows repeated in several tasks
        sets = sets.groupBy("node").agg(F.first("tokens").alias("tokens"))
    both = (pairs.join(sets.select(F.col("node").alias("u"), F.col("tokens").alias("a")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v"))
    shared = F.size(F.array_intersect("a", "b"))
    links = store(both.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v"), "links")
    for done in (pairs, named, sets):
        drop_scratch(done)
    return links


def _components(spark: SparkSession, links: list[DataFrame]) -> DataFrame:
    return contract_edges(reduce(DataFrame.unionByName, links), []).select("node", "root")


def _grouped(docs: DataFrame, width: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, row, n) of every row, and (doc_id, tkey, row, n, root) of those with words."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = store(describe(docs, width, percent), "rows")
    worded = rows.where("n > 0")
    owners = store(worded.select("key", "row", "doc_id", "tkey", "n").join(worded.groupBy("key").agg(F.min("row").alias("node")), "key").drop("key"), "owners")
    copies = owners.where("row <> node").select("row")
    few = copies.count() <= BROADCAST_ROWS
    nodes = worded.join(F.broadcast(copies) if few else copies, "row", "left_anti").withColumnRenamed("row", "node")

    # tokens that several windows share; all others are rare and lead nowhere
    posted = nodes.select("node", F.posexplode("window").alias("pos", "token"))
    known = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = posted.join(known, "token")
    entry = F.struct("pos", "token", (F.col("df") > frequent).alias("often"))
    misses = F.col("n") - F.ceil(percent * F.col("n") / 100)
    profile = store(
        shared.groupBy("node").agg(F.sort_array(F.collect_list(entry)).alias("entries")).join(nodes.select("node", "n"), "node")
        .withColumn("misses", misses).withColumn("held", F.least("n", F.col("misses") + 1 + F.greatest(F.lit(8), F.floor(F.col("misses") / 8))))
        .withColumn("often", F.size(F.filter("entries", lambda x: x["often"])))
        .withColumn("dense", F.col("held") - F.col("often") < F.col("misses") + 1)
        .withColumn("prior", F.size("entries") / F.col("held")), "profile")

    ranked = profile.where("NOT dense").select("node", "n", "misses", "prior", F.explode(rare_places(F.col("entries"))).alias("x"))
    # sets may only link within a size band or between neighbouring ones, so a token meets its sets band by band
    band = F.floor(F.log("n") / F.lit(math.log(100.1 / percent))).cast("int")
    singles = (ranked.where("x.place <= misses").select("node", "prior", "x.sig", F.explode(F.array(band, band + 1)).alias("band"))
               .select("node", "prior", F.xxhash64(F.lit(1), "band", "sig").alias("sig")))
    dense = nodes.join(profile.where("dense").select("node", "prior"), "node")

    wide = _token_sets(docs, store(dense.select("node", "doc_id", "tkey"), "dense"), width, "sigs", lambda tokens: cell_signatures(tokens, percent))
    combined = wide.select("node", F.explode("sigs").alias("sig")).join(profile.select("node", "prior"), "node").select(
        "node", "prior", F.xxhash64(F.lit(2), "sig").alias("sig"))
    index = singles.unionByName(combined)
    met = index.groupBy("sig").agg(F.count("*").alias("n_sig")).where("n_sig > 1").select("sig")
    facts = nodes.select("node", "n", "bits")
    index = store(index.join(met, "sig").select("sig", "node", "prior", F.col("node").alias("root")), "index")

    # rounds in which every entry is compared with one member of its index entry: the most shared, then by a hash
    links: list[DataFrame] = []
    labelled = lambda df: df.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for turn in range(STAR_ROUNDS):
        rank = F.col("prior") if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")
        best = index.groupBy("sig").agg(F.max(F.struct(rank.alias("rank"), "node", "root")).alias("h")).select("sig", F.col("h.node").alias("best"), F.col("h.root").alias("best_root"))
        star = (index.join(best, "sig").where("root <> best_root")
                .select(F.least("node", "best").alias("u"), F.greatest("node", "best").alias("v")).distinct())
        side = lambda name: F.struct("n", "bits").alias(name)
        fitting = (star.join(facts.select(F.col("node").alias("u"), side("a")), "u").join(facts.select(F.col("node").alias("v"), side("b")), "v")
                   .where(_compatible("a", "b", percent)).select("u", "v"))
        links.append(_verified(fitting, docs, nodes, width, percent))
        joined = _components(spark, links)
        apart = labelled(index.select("sig", "node", "prior"))
        still = apart.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("sig")
        following = store(apart.join(still, "sig").select("sig", "node", "prior", "root"), "index")
        drop_scratch(index)
        index = following
        if links[-1].isEmpty():
            break

    # then all that is still apart: within entries, and between sets of the two kinds
    apart = store(index.select("sig", "node", "root").join(facts, "node"), "apart")
    pair = [F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")]
    within = apart.alias("a").join(apart.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.node") < F.col("b.node"))
                                   & (F.col("a.root") != F.col("b.root")) & _compatible("a", "b", percent)).select(*pair)
    lead = profile.select("node", "dense", F.explode(F.filter("entries", lambda x: x["pos"] <= F.col("misses"))["token"]).alias("sig"))
    dense_lead = lead.where("dense").select("node", "sig")
    other_lead = lead.where("NOT dense").join(dense_lead.select("sig").distinct(), "sig").select("node", "sig")
    across = labelled(dense_lead.join(facts, "node")).alias("a").join(
        labelled(other_lead.join(facts, "node")).alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.root") != F.col("b.root")) & _compatible("a", "b", percent)).select(*pair)
    links.append(_verified(within.unionByName(across).distinct(), docs, nodes, width, percent))

    owned = owners.join(_components(spark, links), "node", "left").select("doc_id", "tkey", "row", "n", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "tkey", "row", "n"), owned


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of ``docs``.

    Sets link when 100 * shared >= percent * all. Rows with a null text or no words have 0 shingles, link
    with nothing and are their own component. Rows of equal sets are linked, repeated rows too. Rows with a
    null doc_id link like others; a component without any doc_id is null. Other columns are ignored, an
    empty table gives no rows.
    """
    rows, owned = _grouped(docs, width, percent, frequent)
    smallest = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return owned.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def one_per_component(docs: DataFrame, width: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the smallest doc_id stays, null ids last.

    Rows without words stay. Of rows that repeat doc_id and text one stays.
    """
    rows, owned = _grouped(docs, width, percent, frequent)
    first = owned.groupBy("root").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept_row"))
    stays = owned.join(first, "root").select("doc_id", "tkey", (F.col("row") == F.col("kept_row")).alias("stays"))
    every = stays.unionByName(rows.where("n = 0").select("doc_id", "tkey", F.lit(True).alias("stays")))
    named = store(every.groupBy("doc_id", "tkey").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
                  .where("NOT stays OR n > 1").select(F.col("doc_id").alias("r_doc"), F.col("tkey").alias("r_key"), "stays"), "removed")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    keyed = docs.withColumn("_tkey", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("r_doc")) & (F.col("_tkey") == F.col("r_key"))
    left = keyed.join(few(named.where("NOT stays")), same, "left_anti")
    repeated = named.where("stays")
    if not repeated.isEmpty():
        again = few(repeated)
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_tkey"]))
    return left.select(*docs.columns)


def jaccard_sql(width: int, percent: int) -> str:
    """The components by counting shared shingles of all pairs that share one, and recursion over the links."""
    pieces = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(width))
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {width} THEN list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: {pieces}))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM worded),
posted AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c
                    FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2)
  WHERE 100 * c >= {percent} * (nu + nv - c)),
steps AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM sets UNION SELECT t.v, r.root FROM reach r JOIN steps t ON t.u = r.doc_id WHERE r.root < t.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1) r USING (doc_id)"""
