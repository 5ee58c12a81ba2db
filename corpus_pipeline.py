"""The corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents, those it doesn't know as they stand, whatever their names. No stage loses a row for a null in any
column; what null and repeated doc_ids mean is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import neardup, packing, passages, secret_scan, toxicity
from tidemark.llm.spool import BROADCAST_BYTES, Spool

#: Documents at this score and above are rejected; operator 6 predicts toxic from the same score.
TOXIC = 0.3


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have yet."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with another text; n_chars follows where it changed."""
    same = text.eqNullSafe(F.col("text"))
    chars = F.when(same, F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return docs.select(*(text.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score TOXIC and above go. Every row is judged by its own text, so equal texts share their fate, whatever
    their doc_ids, null ones included; a score of exactly TOXIC goes. Null and empty texts score like a text without words."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filtered(docs, model, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays.

    Where a doc_id is null or repeats, every (doc_id, text) is a document of its own: rows equal in both count once, other
    texts of the same id and texts without an id are judged by content like any document, those without an id last.
    """
    spool = Spool(spark)
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").limit(1).count()
    if odd:
        return _drop_by_text(spool, docs)
    classes = spool.cut(neardup.near_duplicates(docs), "classes")
    later = spool.cut(classes.where("doc_id <> class_id").select("doc_id"), "later")
    small = later.count() * 16 <= BROADCAST_BYTES
    return docs.join(F.broadcast(later) if small else later.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def _drop_by_text(spool: Spool, docs: DataFrame) -> DataFrame:
    """As ``drop_near_duplicates``, by numbers that follow the order of (doc_id, text) in place of the ids."""
    number, key, body = _fresh(docs, "_number", "_key", "_body")
    texts = docs.select(F.col("doc_id").alias(key), F.col("text").alias(body)).distinct().orderBy(F.asc_nulls_last(key), body)
    texts = spool.cut(texts.withColumn(number, F.monotonically_increasing_id()), "texts")
    classes = spool.cut(neardup.near_duplicates(texts.select(F.col(number).alias("doc_id"), F.col(body).alias("text"))), "classes")
    first = texts.join(classes.where("doc_id = class_id").select(F.col("doc_id").alias(number)).hint("merge"), number, "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("text").eqNullSafe(F.col(body))
    return docs.dropDuplicates(["doc_id", "text"]).join(first.hint("merge"), same, "left_semi").select(docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that start in a document with a smaller doc_id go; a row of which no word is left goes whole.

    Rows are judged by doc_id and text: rows equal in both keep the same words, other texts of one doc_id are judged on
    their own, and what recurs only under one doc_id stays. Rows with a null doc_id or text stay as they are.
    """
    name = _fresh(docs, "_spans")[0]
    joined = passages.with_spans(docs, passages.repeated_spans(docs), name)
    spans, words = F.col(name), F.size(F.filter(F.split("text", passages.SPACE), lambda w: w != ""))
    whole = F.when((F.size(spans) == 1) & (spans[0]["first"] == 0), spans[0]["last"] >= words).otherwise(F.lit(False))
    left = joined.where(spans.isNull() | ~whole)
    return _with_text(left, F.when(spans.isNull(), F.col("text")).otherwise(passages.without(F.col("text"), spans)), docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span becomes a mark, overlapping spans one mark. All rows stay; each is judged by its own text, so
    null and repeated doc_ids make no difference, and a null text stays null."""
    name = _fresh(docs, "_found")[0]
    joined = secret_scan.with_found(docs, secret_scan.hits(docs), name)
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(secret_scan.redacted(F.col("text"), F.col(name)))
    return _with_text(joined, text, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row's tokens, placed in sequences. Null and empty texts are the end id alone; repeated rows and
    rows with a null doc_id are packed like others."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained and tokenizing stages have no SQL form. tests/llm holds the rows and texts of the stages after the model's score
#: against brute-force versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spool = spark.read.parquet(f"{sf_dir}/documents.parquet"), Spool(spark)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = spool.cut(docs, f"{at}_{name}")
    return docs
