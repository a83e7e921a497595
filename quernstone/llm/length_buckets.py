"""Packing by optimal length buckets and token-budget batches.

A histogram of all lengths is aggregated on the executors. A dynamic program over it
chooses the bucket boundaries that minimise padding: every document is padded to the
boundary of its bucket. Inside each bucket documents are numbered without gaps, and
each batch takes as many as a budget of padded tokens holds.

The dynamic program is exact over all distinct lengths, at every size. That many lengths
need at least half their square of words, so the histogram that reaches the driver has at
most about the root of twice the corpus's words as rows. Numbering sorts by
pieces: a bucket is dealt over shards by a hash of the row, ranks are taken within
shards, and running totals of the shards' sizes make them consecutive; no bucket
comes together in one task, and only the last batch of a bucket is not full.

Defined cases: a null or empty text has length 0 and is padded as others are. A
document longer than the budget has a batch of its own. Repeated rows are packed as
often as they occur; ties are ordered by identifier (null first) and row hash. An
empty table gives an empty result. Only identifier and text take part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most `buckets` boundaries, ascending, with the least total padding.

    best[j]: the least padding of the j smallest lengths in the buckets so far; the last
    bucket then ends at lengths[j - 1] and starts after some i. The first of the best
    such i never falls as j grows (padding satisfies the quadrangle inequality), so those
    of every second j bound the search for the j between: n log n steps a bucket.
    """
    x, number = np.array(lengths, np.int64), np.array(counts, np.int64)
    size = len(x)
    if not size:
        return []
    n, total = np.concatenate(([0], np.cumsum(number))), np.concatenate(([0], np.cumsum(x * number)))
    last = np.concatenate(([0], x))
    best, cuts = last * n - total, [np.zeros(size + 1, np.int32)]
    for _ in range(min(buckets, size) - 1):
        new, cut = np.zeros(size + 1, np.int64), np.zeros(size + 2, np.int32)
        cut[-1] = size - 1
        step = 1 << size.bit_length()
        while step := step >> 1:
            j = np.arange(step, size + 1, 2 * step)
            low, high = cut[j - step].astype(np.int64), np.minimum(cut[np.minimum(j + step, size + 1)], j - 1)
            widths = high - low + 1
            starts = np.cumsum(widths) - widths
            i = np.arange(widths.sum()) + np.repeat(low - starts, widths)
            own = np.repeat(j, widths)
            cost = best[i] + last[own] * (n[own] - n[i]) - (total[own] - total[i])
            new[j] = np.minimum.reduceat(cost, starts)
            hits = np.flatnonzero(cost == np.repeat(new[j], widths))
            cut[j] = i[hits[np.searchsorted(hits, starts)]]
        best = new
        cuts.append(cut[:-1])
    ends, j = [], size
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(lengths[j - 1])
        j = int(cut[j])
    return ends[::-1]


def packed(
    spark: SparkSession, docs: DataFrame, buckets: int = 16, budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 50_000
) -> DataFrame:
    """A row for every document: doc_id, length, bucket, padded, batch, slot, batch_rows.

    `batch` counts from 0 within its bucket, `slot` within its batch; `padded` is the
    bucket's boundary and the length that each row of its batches takes.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(common.WORD)), F.lit(0)).cast("bigint").alias("length"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("mix"),
    )
    rows = common.written(spark, rows, "packing-lengths")
    histogram = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("length")  # a row for each distinct length
    if not len(histogram):
        return rows.select(F.col("id").alias(id_col), "length", *(F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("padded", "bigint"), ("batch", "bigint"), ("slot", "bigint"), ("batch_rows", "bigint"))))
    counts = histogram["n"].to_pylist()
    ends = boundaries(histogram["length"].to_pylist(), counts, buckets)

    bucket, padded = F.lit(len(ends) - 1), F.lit(ends[-1])
    for i in range(len(ends) - 2, -1, -1):
        inside = F.col("length") <= ends[i]
        bucket, padded = F.when(inside, i).otherwise(bucket), F.when(inside, ends[i]).otherwise(padded)
    shards = max(8, sum(counts) // (shard_rows * len(ends)) + 1)
    rows = rows.withColumns({"bucket": bucket, "padded": padded.cast("bigint"), "shard": F.pmod("mix", F.lit(shards))})

    sizes = rows.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("bucket")).alias("bucket_rows"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("length", "id", "mix")) - 1
    holds = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("padded", F.lit(1)))).cast("bigint")
    place = F.col("offset") + F.col("rank")
    batch = F.floor(place / holds).cast("bigint")
    return (
        rows.withColumn("rank", rank)
        .join(offsets, ["bucket", "shard"])
        .select(
            F.col("id").alias(id_col),
            "length",
            F.col("bucket").cast("int").alias("bucket"),
            "padded",
            batch.alias("batch"),
            (place - batch * holds).alias("slot"),
            F.least(holds, F.col("bucket_rows") - batch * holds).alias("batch_rows"),
        )
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot."""
    return packed(spark, common.documents(spark, sf_dir))
