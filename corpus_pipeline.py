"""A corpus cleaned, deduplicated, mixed and packed, stage by stage.

Each stage works on all that the one before kept, read again from Parquet, and returns
the columns of its input, the last one the places of documents in batches. Cases that all
stages define: an empty table gives an empty result; further columns ride along, whatever
their names, and play no part; what a null text, identifier or source means is with each
stage; ties fall by identifier, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import common, entropy_mix, length_buckets, near_dedup, stream_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold.

    A null text counts as empty; very long texts are scored whole; repeated rows share a
    score. Without labels of both classes all texts have one score.
    """
    common.arrow_rows(spark)
    machine = toxicity.learn(docs, common.labels(spark, sf_dir))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    scored = toxicity.scored(own, machine, names[docs.columns.index("text")])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the row with the largest identifier, null the least.

    A null text counts as empty, so one of all empty and null texts stays.
    """
    return stream_dedup.deduplicated(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles, similarity 0.8.

    The row with the smallest identifier stays, null the largest. Texts without words are
    near to nothing, so all of them stay.
    """
    common.arrow_rows(spark)
    return near_dedup.deduplicated(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, from 0 to 3 times.

    A null source is a source of its own. Texts without words add nothing and are taken
    by their source's rate as others are.
    """
    return entropy_mix.copied(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document that is left; a null text has length 0."""
    return length_buckets.packed(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A trained model, minhashes, Newton steps and a dynamic program have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
