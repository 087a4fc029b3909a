"""Corpus pipeline: documents to training sequences, one operator per stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlake.llm import contamination, language, lines, packing, simhash
from incidentlake.llm.common import table
from incidentlake.llm.queries import vocabulary
from incidentlake.session import shared_dir

#: A document whose main language has less than this share of its text is rejected, as is one without letters. With few
#: languages some language always has that much, so the share must also exceed the even one by ``ABOVE_EVEN``.
LEAST_SHARE, ABOVE_EVEN = 0.2, 1.1


def least_share(languages: int) -> float:
    """Least share of a main language; of one or two languages the larger is always the main one."""
    return max(LEAST_SHARE, ABOVE_EVEN / languages) if languages > 2 else LEAST_SHARE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known main language. The model learns from the labels of the stage's own input.

    Rejected: null and empty texts, texts without a letter, texts whose main language has
    less than ``least_share`` of the mixture, and texts in none of the learned languages
    (letter junk, other languages): their trigrams are less likely than ``language.least_fit``.
    A document with null id goes only for want of letters. A repeated id goes if one of its
    rows is rejected. All columns stay as they are.
    """
    model = language.train(docs)
    rejected = language.predict(docs, model, with_fit=True) \
        .where((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < least_share(len(model.languages))) | (F.col("fit") < F.col("least_fit")))
    return docs.join(rejected.where("id is not null").select(F.col("id").alias("doc_id")).distinct(), ["doc_id"], "left_anti") \
        .where(F.col("doc_id").isNotNull() | F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line repeats; documents left without a line go.

    ``n_chars`` is counted anew.
    """
    kept = lines.drop_lines(docs, lines.line_decisions(docs))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return simhash.keep_one_per_group(docs, simhash.simhash_groups(docs, words=4, bits=4))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return contamination.without_leaks(docs, contamination.leaks(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Mixtures, fingerprints and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row; each stage's result is written to the shared folder and read again."""
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
