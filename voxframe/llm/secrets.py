"""Secret scans with corpus-wide ownership frequency, in built-in functions.

Patterns propose candidates. The hash of each candidate value is aggregated over the whole corpus by
distinct repositories and owners: a value that many owners hold, or that few hold in very many repositories,
is a copied example; the others look live. Long tokens without a keyword become findings of their own when they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .spans import SPAN, count_kind, digest, kept_spans, locate, merged

BASE = ("assign", "access", "hex")
BARE = "bare"
# The last two are written so that only whole runs are tried; the runs they find are those of the plain patterns.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}",
    BARE: r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}",
}
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$"""


def scan(docs: DataFrame, doc_id: str = "doc_id", owner: str = "source", repository: str | None = None, text: str = "text") -> DataFrame:
    """Candidates of every row: doc_id, owner, repository, text_key, base and bare spans. Null texts are empty."""
    repository = repository or doc_id
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.col(repository).alias("repository"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = locate(body, "text", PATTERNS)
    secret = lambda m: F.length(F.regexp_extract(m, VALUE, 1)) >= 8
    anything = lambda m: F.lit(True)
    mixed = lambda m: m.rlike("[0-9].*[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    return found.select(
        "doc_id", "owner", "repository", F.xxhash64("text").alias("text_key"),
        merged(kept_spans("assign", 0, secret), kept_spans("access", 1, anything), kept_spans("hex", 2, anything)).alias("base"),
        F.coalesce(kept_spans(BARE, 3, mixed), F.array().cast(SPAN)).alias("bare"))


def value_hash(span: Column) -> Column:
    """Hash of the secret itself: what follows the sign in an assignment, else the whole match."""
    value = F.when(span["kind"] == "assign", F.regexp_extract(span["value"], VALUE, 1)).otherwise(span["value"])
    return F.sha2(value, 256)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) over the whole corpus; every step aggregates before it shuffles."""
    held = candidates.select("hash", "owner", "repository").distinct()
    return (held.groupBy("hash", "owner").agg(F.count("*").alias("n"))
            .groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners")))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", owner: str = "source", repository: str | None = None,
                 text: str = "text", copied_owners: int = 4, copied_repositories: int = 64) -> DataFrame:
    """Findings per row: doc_id, base (spans), spans (base and live-looking bare ones), n_live, n_copied.

    A value held by ``copied_owners`` owners or more, or by more than ``copied_repositories`` repositories
    per owner, is a widely copied example. Bare tokens that touch
    a base span, or that are examples, are no findings. Null and empty texts have no spans, identical
    rows give identical results, a null doc_id or owner is a value like others, an empty table gives
    no rows; other columns are ignored.
    """
    scanned = cut_lineage(scan(docs, doc_id, owner, repository, text))
    free = F.filter("bare", lambda b: ~F.exists("base", lambda s: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    found = (scanned.where((F.size("base") > 0) | (F.size("bare") > 0))
             .select("doc_id", "owner", "repository", "text_key", F.explode(F.concat("base", free)).alias("span"))
             .withColumn("hash", value_hash(F.col("span"))))
    judged = found.join(ownership(found), "hash").withColumn(
        "live", (F.col("n_owners") < copied_owners) & (F.col("n_repositories") <= copied_repositories * F.col("n_owners")))
    per_row = judged.groupBy(F.col("doc_id").alias("f_doc"), F.col("text_key").alias("f_key")).agg(
        F.collect_set(F.when((F.col("span.kind") == BARE) & F.col("live"), F.col("span"))).alias("added"),
        F.collect_set(F.when(F.col("live"), F.col("hash"))).alias("live"), F.collect_set(F.when(~F.col("live"), F.col("hash"))).alias("copied"))
    joined = scanned.join(per_row, F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("text_key") == F.col("f_key")), "left")
    return joined.select("doc_id", "base", merged(F.col("base"), F.col("added")).alias("spans"),
                         F.greatest(F.size("live"), F.lit(0)).cast("long").alias("n_live"),
                         F.greatest(F.size("copied"), F.lit(0)).cast("long").alias("n_copied"))


def secret_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE],
                        F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
                        "n_live", "n_copied")
