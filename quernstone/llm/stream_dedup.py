"""Exact deduplication with keyed streaming state.

Rows stream past a state store keyed by the digest of their text. The state lives
in RocksDB on disk, is checkpointed to the shared folder and never expires: it holds
for each digest the number of rows, and the stable identifier and locator of the row
that stays. Partial aggregation before the shuffle leaves one row per task for a hot
digest. On hits the full bytes are compared: of a digest seen more than once, the
smallest and the largest text must be the same; where they differ, the digest's
rows are grouped by text instead.

Defined cases: a null text counts as empty. A null identifier sorts before all
others. Of rows equal in identifier and text, the one with the largest locator
stays. An empty table gives an empty result. Further columns play no part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "struct<id:bigint,at_file:bigint,at_row:bigint>"


def sha256(text: F.Column) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def retained(rows: DataFrame) -> DataFrame:
    """The state's aggregate: batch or streaming rows (digest, id, at_file, at_row)."""
    return rows.groupBy("digest").agg(
        F.max(F.struct("id", "at_file", "at_row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )


def run_stream(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Drives the streaming rows through the state; returns one row per digest.

    Each micro-batch writes the keys that it touched below its own number, so a
    batch that is run again after a failure replaces what it wrote before. A later
    call on the same folder goes on from the checkpointed state.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/index/batch={number}")

    query = (
        retained(rows)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    return newest(spark, folder)


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a stream's folder: a digest's entry of its highest batch."""
    schema = f"digest string, keep {_ROW}, group_size bigint, batch bigint"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/index")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).drop("batch")
    index = spark.read.schema(schema).option("basePath", f"{folder}/index").parquet(f"{folder}/index")
    return index.groupBy("digest").agg(F.max_by(F.struct("keep", "group_size"), "batch").alias("s")).select("digest", "s.*")


def _held_texts(tables: common.Scratch, folder: str, held: DataFrame, text_col: str) -> DataFrame:
    """digest, keep and text of rows that earlier calls kept: `held` has digest and keep."""
    spark, held = tables.spark, tables.table(held, "held")
    files = spark.read.parquet(f"{folder}/files").join(held.select(F.col("keep.at_file").alias("at_file")).distinct(), "at_file", "left_semi")
    paths = [r["at_path"] for r in files.select("at_path").distinct().collect()]  # as many as input files with hits
    if not paths:
        return held.select("digest", "keep", F.lit("").alias("t")).where(F.lit(False))
    rows = common.located(spark, spark.read.parquet(*paths), {"t": text_col}, "dedup-held")
    at = [F.col("keep.at_file") == F.col("at_file"), F.col("keep.at_row") == F.col("at_row")]
    return rows.join(common.broadcast_if_small(held, held.count()), at).select("digest", "keep", F.coalesce("t", F.lit("")).alias("t"))


def decide(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256,
    files_per_batch: int = 512,
    folder: str | None = None,
) -> DataFrame:
    """A decision for every row of `docs`.

    Returns id, at_file, at_row, digest, keep (struct of id, at_file, at_row),
    group_size and kept. `digest` maps a text column to a string column; any
    function is safe, as full bytes decide on hits. `folder` holds the state of earlier
    calls, over tables with the same text column; none starts afresh.
    """
    again = folder is not None
    folder = folder or common.shared_dir(spark, "dedup")
    if again and not common._reads_files(docs):  # later calls read texts from these files
        docs.write.parquet(kept := f"{folder}/rows-{uuid.uuid4().hex[:12]}")
        docs = spark.read.schema(docs.schema).parquet(kept)
    rows = common.located(spark, docs, {"id": id_col, "t": text_col}, "dedup-rows")
    rows = rows.withColumn("id", F.col("id").cast("bigint")).withColumn("t", F.coalesce("t", F.lit("")))
    keyed = rows.withColumn("digest", digest(F.col("t")))
    narrow = keyed.select("digest", "id", "at_file", "at_row")
    call = f"{folder}/digests/call-{uuid.uuid4().hex[:12]}"
    narrow.write.parquet(call)
    tables = common.Scratch(spark, "dedup-tables")
    before = tables.table(newest(spark, folder), "before") if again else None
    if again:
        path = F.col("_metadata.file_path")
        docs.select(F.xxhash64(path).alias("at_file"), path.alias("at_path")).distinct().write.mode("append").parquet(f"{folder}/files")

    side = spark.newSession()  # the state store's settings stay out of the caller's session
    side.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    side.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    side.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    side.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Else every store reserves 4 MB of disk for its manifest.
    side.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    stream = side.readStream.schema(narrow.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/digests/*")
    run_stream(side, stream, folder)

    digests = spark.read.schema(narrow.schema).parquet(call)
    index = tables.table(newest(spark, folder), "index")
    hits = index.where("group_size > 1").select("digest")
    few = common.broadcast_if_small(hits, hits.count())
    # Full bytes on hits, without bringing a group together: each task sends on at most two texts of a digest.
    texts = keyed.join(few, "digest", "left_semi").select("digest", "t")
    old = None
    if before is not None:
        met = before.join(digests.select("digest").distinct(), "digest", "left_semi").select("digest", "keep")
        old = tables.table(_held_texts(tables, folder, met, text_col), "held-texts")
        texts = texts.unionByName(old.select("digest", "t"))
    extremes = texts.groupBy("digest").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    clashes = tables.table(extremes.where("low <> high").select("digest"), "clashes")

    joined = digests.join(index, "digest")
    if n := clashes.count():
        unlike = common.broadcast_if_small(clashes, n)
        odd = keyed.join(unlike, "digest", "left_semi")
        places = odd.select("digest", "t", F.struct("id", "at_file", "at_row").alias("keep"))
        if old is not None:
            places = places.unionByName(old.join(unlike, "digest", "left_semi").select("digest", "t", "keep"))
        groups = places.groupBy("digest", "t").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        apart = odd.join(groups, ["digest", "t"]).select(*joined.columns)
        joined = joined.join(unlike, "digest", "left_anti").unionByName(apart)
    kept = F.struct("id", "at_file", "at_row").eqNullSafe(F.col("keep"))
    tables.drop_all_but("index", *(("clashes", "held-texts") if n else ()))
    return joined.select("id", "at_file", "at_row", "digest", "keep", "group_size", kept.alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that an equal text replaces; columns as they are."""
    if not common._reads_files(docs):
        docs = common.written(spark, docs, "dedup-docs")
    dropped = common.written(spark, decide(spark, docs, id_col, text_col).where("not kept").select("at_file", "at_row"), "dedup-dropped")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = common.located(spark, docs, dict(zip(names, docs.columns, strict=True)), "dedup-docs")
    rest = rows.join(common.broadcast_if_small(dropped, dropped.count()), ["at_file", "at_row"], "left_anti")
    return rest.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return decide(spark, common.documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        "kept",
        F.col("digest").alias("text_sha256"),
    )


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
