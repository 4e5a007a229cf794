"""A corpus pipeline of five stages; each works on the whole table that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxframe.llm import jaccard, langid, packing, pii, quality
from voxframe.llm.tables import small_batches, store, table

#: No SQL for trained models, tokens and packing; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the model, learnt from all labelled ones, keep."""
    small_batches(spark)
    return quality.judge(docs, quality.train_all(docs, table(spark, sf_dir, "labels"))).where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the models are learnt from all documents of their folds."""
    small_batches(spark)
    return langid.identify(docs, langid.train(docs, None)).where("NOT rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8.

    Texts without words are no one's duplicates, so null and empty texts stay; of repeated rows one stays.
    """
    small_batches(spark)
    return jaccard.one_per_component(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text.

    Null texts stay null; repeated rows stay and change alike.
    """
    found = pii.find_pii(docs).withColumn("text", pii.redact(F.col("text"), F.col("pii")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as token pieces with their places in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", near_duplicates),
          ("PII", personal_data), ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
