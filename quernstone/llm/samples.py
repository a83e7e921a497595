"""Bounded samples of labelled documents for fitting classifiers.

The bound is a parameter: at most so many rows of each class, those with the
smallest hash of their identifier, so a rerun takes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most_per_class: int) -> DataFrame:
    """Rows (id, text, label, turn) to learn from; `turn` orders them for good.

    Rows without identifier or label are left out, as is the held-out fold. Of
    several labels of one document the largest counts; of repeated documents with
    one identifier the greatest text, so the bound holds. The choice is made on the
    labels alone and its size is bounded, so it is broadcast to the scan of texts.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~common.held_out(F.col("doc_id"), folds, fold))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .withColumn("turn", F.xxhash64("id", F.lit(17)))
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("turn", "id").limit(most_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return rows.groupBy("id", "label", "turn").agg(F.max("text").alias("text"))


def class_counts(labels: DataFrame, label: str, folds: int, fold: int) -> tuple[int, int]:
    """Labelled rows of class 0 and 1 outside the held-out fold."""
    rows = labels.where(~common.held_out(F.col("doc_id"), folds, fold)).select(F.col(label).cast("int").alias("label"))
    found = rows.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).first()
    return found["n0"], found["n1"]
