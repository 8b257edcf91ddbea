"""A corpus from raw documents to packed sequences: five operators in a row, each over all that its predecessor kept.

Defined results, of every stage and of ``run``: a null text counts as an empty one, which the quality rules reject, and
which the other stages keep; texts of any length count whole; rows that repeat an id are judged each by its own text;
rows equal in id and text are copies, of which near-duplicate removal keeps one; ties between documents go to the smaller
id; rows without an id are never taken for duplicates; an empty table gives an empty table with the stage's columns; extra
columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm.packing import pack_documents
from lorekeep.llm.quality_rules import quality_filter
from lorekeep.llm.shared import ensure_checkpoint_dir, table
from lorekeep.llm.simhash import one_of_each
from lorekeep.llm.substring_dedup import cut_passages
from lorekeep.llm.toxicity import toxicity_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_filter(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; trained on the labelled ones among ``docs``."""
    return toxicity_filter(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest id."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each repeated passage left in the first one only."""
    return cut_passages(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the trained grammar nor the passages nor the tokenizer; tests hold the result against brute force.
ORACLE_SQL = None


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again. A stage's result
    goes when the next one is written; the last one stays, as the rows that are returned are read from it."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), ""
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
