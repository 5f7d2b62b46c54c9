"""Corpus pipeline: documents to training ids in five stages, each one of the corpus operators over all rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidra.llm import mixing, orderhash, quality, recompression, sentencepieces
from obsidra.llm.common import read_table, staged
from obsidra.llm.queries import PIECE_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on the rated ones among them, expects to be good."""
    model = quality.train(docs, quality.graded(read_table(spark, sf_dir, "labels")))
    return _documents(quality.score(docs, model).where("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return _documents(orderhash.deduplicated(docs))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier; an untouched text keeps its spacing."""
    done = recompression.substring_dedup(docs.withColumn("original", F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("original"))
    return _documents(done.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by temperature weights: all at least once, none more than twice as often as another.

    Rows of a task stand in the order of the mixture: by epoch, then by the block's turn, then inside the block.
    """
    return _documents(mixing.mix(docs, max_repeat=2.0).sortWithinPartitions("mix_epoch", "mix_block_rank", "mix_order"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document passed."""
    return sentencepieces.encode(docs, sentencepieces.load(PIECE_MODEL)).select("doc_id", "lang", "source", "n_ids", "ids", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The first stage trains a model and the last one runs a tokenizer: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
