"""Queries of the corpus operators over the whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, decontaminate, embedding_lsh, lang_id, mixing, quality_cnn, secret_scan, substring_words, suffix_array, url_filter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_url_filter": url_filter.judge_sql()}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document belongs to the fold that nothing is learned from; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.taken_text(mixed, "doc_id", unused_too=True).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "class_size")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(learnable(docs))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), lang_id.predict(model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_cnn.Model:
    """Fit on the labelled documents outside the held-out fold."""
    return quality_cnn.fit(learnable(docs), learnable(labels))


@query
def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), quality_cnn.score(model, F.col("text")).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= quality_cnn.THRESHOLD, 1).otherwise(0))


@query
def op6_substring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.repeated_words_digest(table(spark, sf_dir, "documents"))


@query
def op7_embedding_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_lsh.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secret_scan.span_label().alias("spans"), "n_live", "n_copied")


@query
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.repeated_bytes_digest(table(spark, sf_dir, "documents"))
