"""The registered queries of the subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, compression, fingerprint, jaccard, langid, merkle, packing, pii, quality, secrets, sharding, trie
from .tables import table

CONTROL_CHAT = """SELECT -7 AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
                  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'"""


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_low")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_digest(bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.identify(docs.select("doc_id", "text"), langid.train(docs.select("doc_id", "text", "lang")))
    return told.select("doc_id", F.coalesce(langid.fold_of("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(chat.format_chats(turns.unionByName(spark.sql(CONTROL_CHAT))))


def op11_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = compression.score(docs, compression.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(compression.fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_jaccard, op3_sharding, op4_bpe, op5_secrets, op6_pii, op7_fingerprint, op8_language, op9_packing, op10_chat,
                                     op11_compression, op12_merkle, op13_trie)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {
    "op2_jaccard": jaccard.jaccard_sql(3, 90), "op3_sharding": sharding.sharding_sql(), "op10_chat": chat.chat_sql(CONTROL_CHAT),
    "op12_merkle": merkle.manifest_sql(), "op13_trie": trie.trie_sql()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
