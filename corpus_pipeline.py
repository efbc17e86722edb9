"""The training-data pipeline: toxic documents go, one of each group of near-duplicates stays, repeated passages are cut out,
and what is left is packed into sequences. Each stage works on all that the one before it kept.

A stage's last step runs when its result is written, so the stages set how many bytes of texts a Python worker gets at a time
(`spark.sql.execution.arrow.maxBytesPerBatch`) for the whole session; a smaller value of the session stays."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.llm import common, minhash, packing, substrings, toxicity
from ionframe.llm.queries import END_ID, WORD_FILE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on those with labels, does not call toxic."""
    common.set_batches(spark)
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    common.set_batches(spark)
    return minhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of fifty words that an earlier document holds; n_chars follows the text."""
    common.set_batches(spark)
    cut = substrings.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    now = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", now)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences with their ids."""
    common.set_batches(spark)
    return packing.pack(docs, public_tokenizers.path(WORD_FILE), END_ID, keep_memory=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: Tokenizers, hashed sketches and trained models are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = common.staged(docs)
    return docs
