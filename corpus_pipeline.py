"""A corpus pipeline of five stages: quality filter, near-dedup, substring dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.minhash import near_duplicates
from tidewatch.llm.mix import mix_sources
from tidewatch.llm.quality import document_statistics, fit_quality, scored_texts
from tidewatch.llm.spm import encode_and_sample
from tidewatch.llm.substring import remove_repeats
from tidewatch.llm.common import durable, lean_batches, once


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from this input's labelled rows."""
    lean_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(durable(document_statistics(docs), "stats"), labels)
    return scored_texts(docs, model).where("_score >= 0.3").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id; repeats of one row (same id
    and text) stay once. Rows without id are no one's copies."""
    lean_batches(spark)
    copies = near_duplicates(docs).where(~F.col("kept") & F.col("component_id").isNotNull()).select("doc_id").distinct()
    return once(docs.join(copies, "doc_id", "left_anti").select(docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has too."""
    lean_batches(spark)
    cut = remove_repeats(docs)
    text = F.col("_kept_text")
    return cut.select([text.alias("text") if c == "text" else F.coalesce(F.length(text), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target rate draws it, in a global shuffle. The copies have
    the columns of documents alone, so that the next stage samples them alike."""
    return mix_sources(docs).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and the scores of its sampled segmentations."""
    lean_batches(spark)
    coded = encode_and_sample(docs.select("doc_id", "source", "text"), with_ids=True)
    return coded.select("doc_id", "source", F.col("_n_pieces").alias("n_pieces"), F.col("_ids").alias("piece_ids"), F.col("_round_trip").alias("round_trip"), F.col("_samples").alias("samples"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]
#: SQL expresses neither the classifier nor the sampled encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
