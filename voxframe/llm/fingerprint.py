"""Threshold-scaled fingerprints: every shingle hash below a fixed fraction of the hash space, and the smallest.

Kept hashes depend on the shingle alone, so sketches of parts merge to the sketch of the whole, and the share of
one sketch found in another estimates containment however unequal the documents are. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 3            # words in a shingle
FRACTION = 0.25      # of all hashes that are kept
BUCKETS_PER_PARTITION = 4


def add_sketch(df: DataFrame, text: str, into: str, width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """Add the sorted kept hashes of ``text``.

    A text of fewer words than a shingle is one shingle, a text without words (or null) has an empty sketch.
    The smallest hash is kept in any case, so no text with words is without a sketch.
    """
    if not 0 < fraction <= 0.5:
        raise ValueError("the fraction lies above 0 and up to 0.5")
    limit = int(fraction * 2.0**64)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    worded = df.withColumn("_words", words)
    many = F.size("_words")
    at = lambda i, k: F.get(F.col("_words"), i + k)
    shingles = F.when(many >= width, F.transform(F.sequence(F.lit(0), many - width), lambda i: F.xxhash64(*[at(i, k) for k in range(width)]))
                      ).when(many > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<long>"))
    hashed = worded.withColumn("_hashes", shingles)
    # hashes are signed: those from 0 on are half of the space
    low = F.filter("_hashes", lambda h: (h >= 0) & (h < limit))
    return (hashed.withColumn("_least", F.array_min(F.transform("_hashes", lambda h: h.bitwiseXOR(F.lit(-(1 << 63))))).bitwiseXOR(F.lit(-(1 << 63))))
            .withColumn(into, F.array_sort(F.array_compact(F.array_union(low, F.array("_least"))))).drop("_words", "_hashes", "_least"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts taken together (their shingle sets joined)."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; 0 when either sketch is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; 0 when a is empty."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, F.hex), ",")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next one by descending doc_id; the last is followed by the first.

    Null texts count as empty. Rows of equal doc_id are ordered by a hash of their text; null ids come last.
    Rows are dealt to id ranges (quantiles of doc_id), and each range gets a copy of the row that follows it,
    so one exchange of the texts suffices and no task sees more than its ranges.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts), reverse=True)]) if cuts else F.array().cast("array<long>")
    number = F.when(F.col("doc_id").isNull(), F.lit(1 << 30)).otherwise(F.size(F.filter(bounds, lambda b: b > F.col("doc_id"))))
    rows = rows.withColumn("range", number).withColumn("tie", F.xxhash64("text"))
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.col("tie"))
    heads = rows.groupBy("range").agg(F.max_by("text", place).alias("text"))
    every = Window.orderBy("range")                     # one row per range
    circle = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ghosts = heads.select(F.coalesce(F.lag("range").over(every), F.last("range").over(circle)).alias("range"), "text",
                          F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("tie"), F.lit(True).alias("ghost"))
    line = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return (rows.withColumn("ghost", F.lit(False)).unionByName(ghosts).withColumn("next_text", F.lead("text").over(line))
            .where(~F.col("ghost")).select("doc_id", "text", "next_text"))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likenesses; see ``with_next``.

    Further columns are ignored, repeated rows stay, an empty table gives no rows. A likeness is 0 when
    either text has no words.
    """
    chars = F.length("text")
    swapped = F.floor(chars / 3).cast("int")
    edited = F.concat(F.left("text", chars - swapped), F.left("next_text", swapped))
    rows = with_next(docs).withColumn("n_chars", chars.cast("long")).withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    for text, into in (("text", "own"), ("edited", "other"), ("next_text", "following")):
        rows = add_sketch(rows, text, into).drop(text)
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
                       containment(F.col("own"), F.col("other")).alias("held_by_edited"))
