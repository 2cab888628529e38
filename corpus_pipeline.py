"""A corpus pipeline of the llm operators: STAGES, run(), ORACLE_SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numfold.llm import bpe, decontaminate, langid, minhash, secrets
from numfold.llm.common import Scratch, clear, mark
from numfold.llm.queries import vocabulary

BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no letter, or no language with a score of 0.5.

    The model learns from the rows that have a language; `lang` of the rows that stay is the
    recognised one, also where it was missing."""
    model = langid.fit(docs)
    return langid.recognised(docs, model, least=0.5, lang_col="lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id stays.

    Of rows that share an id the least one (by text, then the other columns) stays; rows with
    a null id stay."""
    scratch = Scratch(spark, "near-dedup")
    name = "gone"
    while name in docs.columns:
        name += "_"
    found = scratch.keep(minhash.near_duplicates(docs, shingle=5, percent=80).where("doc_id is not null").select("doc_id", "kept"))
    gone = scratch.keep(found.where("not kept").select(F.col("doc_id").alias(name)).distinct())
    twice = scratch.keep(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(name)))
    hint = F.broadcast if gone.count() <= BROADCAST_IDS else lambda x: x  # 8 bytes each
    left = docs.join(hint(gone), docs["doc_id"] == F.col(name), "left_anti")
    if twice.isEmpty():
        return left
    same = left["doc_id"] == F.col(name)
    order = ["text", *(c for c in docs.columns if c != "text")]
    least = left.join(twice, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*order)).alias(name)).select(f"{name}.*").select(*docs.columns)
    return left.join(twice, same, "left_anti").union(least)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's five-word shingles go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shingle=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind, and n_chars follows."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every text."""
    return bpe.round_trip(docs, vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", bpe_encoding),
]

#: SQL expresses neither the language model nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        since = mark()
        docs = scratch.keep(stage(spark, docs, sf_dir))
        clear(spark, since)  # the stage's own tables
    return STAGES[-1][1](spark, docs, sf_dir)
