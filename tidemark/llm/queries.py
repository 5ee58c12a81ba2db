"""The registered queries of the subpackage: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import annforest, bpe, cotrain, langid, neardup, packing, passages, quality_rules, secret_scan, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(m: int, r: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % m == r, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = langid.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = langid.train(langid.sample_words(docs.where(~_remainder(3, 1))), pieces)
    return langid.identify(docs, model).select("doc_id", _remainder(3, 1).alias("held_out"), "lang_pred", "score")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.verdict(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask(quality_rules.BASE))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", base.alias("base_failed"), "kept")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    table = cotrain.features(docs)
    scored = cotrain.score(table, cotrain.fit(table, labels.where(~_remainder(4, 3))))
    return scored.select("doc_id", _remainder(4, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~_remainder(4, 2))))
    return scored.select("doc_id", _remainder(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return passages.kept_words(docs, passages.repeated_spans(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda x: x["rank"] <= 3)
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(found).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language, op2_near_duplicates, op3_quality_rules, op4_bpe, op5_quality, op6_toxicity, op7_nearest, op8_repeated_passages, op9_packing, op10_secrets)
}

ORACLES: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE}
