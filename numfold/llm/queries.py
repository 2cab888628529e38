"""Queries of the pipeline operators: whole tables, production parameters.

A fold is a remainder of crc32(doc_id as text); a row with a null id has a null held_out,
never trains, and is scored like any other."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, decontaminate, langid, minhash, quality, secrets, substring, vectors, warc
from .common import fold
from .oracles import ORACLES


def vocabulary() -> str:
    """The tokenizer file: NUMFOLD_VOCABULARY, or the installed public one."""
    if found := os.environ.get("NUMFOLD_VOCABULARY"):
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))  # a null fold is left out
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"), window=20)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return found.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs, quality.fit(docs, labels.where(fold("doc_id", 5) != 0)))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, percent=80)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least=0)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_language_id, op3_substring_dedup, op4_near_dedup, op5_secret_scan, op6_lm_score, op7_quality, op8_decontamination, op9_warc, op10_embedding_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
