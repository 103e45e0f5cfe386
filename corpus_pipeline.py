"""From raw documents to a training mix: five stages, each written and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bagminhash, decontaminate, mixing, quality_cnn, secret_scan
from barloom.llm.common import drop_folder, shared_folder, table
from barloom.llm.queries import quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts, unchanged, with all their columns.

    It is fitted on labelled documents outside the held-out fold; without any it accepts all.
    Null and empty texts are judged as an empty text, long ones in all their chunks; repeated
    rows are judged alike, a score at the threshold is accepted, and an empty table stays empty.
    """
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_cnn.score(model, F.col("text")) >= quality_cnn.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, unchanged: that of least doc_id, of equal ones of least key.

    Null and empty texts are one text, so one of them stays; of repeated rows one stays; a
    null doc_id is larger than all others. Long texts are compared whole; an empty table stays empty.
    """
    return bagminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, unchanged.

    Null and empty texts hold none; long texts are searched whole; repeated rows go or stay
    together. Without items all documents stay, and an empty table stays empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text.

    Values that many sources hold are replaced, too: a pattern that is listed counts wherever
    it stands. Null and empty texts stay as they are, repeated rows change alike, long texts
    are scanned whole, and an empty table stays empty.
    """
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document that it takes words of, with these words and their places in its blocks.

    Null and empty texts have no words, so they are not in it; repeated rows are packed each
    on their own; a long text runs over many blocks. A null source is one of its own, the
    last. An empty table makes an empty mix.
    """
    return mixing.taken_text(mixing.mix(docs.select("doc_id", "text", "lang", "source")), "doc_id", "lang", "source")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("mixing", mixture),
]

#: A trained network, hashing and regular expressions with offsets are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if k:  # what the stage before it wrote is not read again
            drop_folder(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
