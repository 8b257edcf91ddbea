"""Labelled rows for training: held-out folds and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal digits, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(folds)).cast("int")


def training_ids(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(id, y): about ``per_class`` labelled rows of each class at most, chosen by a hash of the id, none held out.

    Ids with contradicting labels are left out. The result's size is bounded by the parameter, whatever the input's.
    """
    y = F.col(label).cast("int")
    rows = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1)).where(remainder(F.col("doc_id"), folds) != held_out)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(y).alias("y"), F.max(y).alias("most")).where("y = most").drop("most")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("id", F.lit(label)), F.lit(1_000_000))
    take = F.lit(False)
    for cls, n in counts.items():
        take = take | ((F.col("y") == cls) & (draw < int(1_000_000 * min(1.0, per_class / max(n, 1)))))
    return rows.where(take)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(id, text, y). The sample's ids are broadcast: there are about 2 x ``per_class`` of them at most."""
    ids = training_ids(labels, label, folds, held_out, per_class)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return texts.join(F.broadcast(ids), "id")
