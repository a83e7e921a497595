"""Shared folders, written tables and row locators for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the five ASCII controls.
WORD = r"[^\x20\x09-\x0D]+"

#: Columns of `documents`.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the one that driver and executors share.

    That is the session's `spark.checkpoint.dir`. Where it is unset, a session on this
    machine alone makes a temporary folder its checkpoint folder; on a cluster, whose
    executors would each write to a disk of their own, it is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


class Scratch:
    """Tables of one call in a shared folder of their own; later reads need no lineage."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.folder, self.made = spark, shared_dir(spark, tag), []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """`df`, written and read again."""
        path = f"{self.folder}/{name}-{len(self.made)}"
        self.made.append((name, path))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, *names: str) -> None:
        """Deletes the tables that no result reads any more.

        Spark removes shuffle files and broadcasts of finished steps, on all machines, once
        the driver has collected what refers to them, so that is done here too.
        """
        for name, path in self.made:
            if name not in names:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.made = [x for x in self.made if x[0] in names]
        self.spark._jvm.System.gc()


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """`df` as a table in the shared folder: later reads need none of its lineage."""
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _reads_files(df: DataFrame) -> bool:
    """Whether `df` is a file scan under nothing but projections and filters."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation") and "HadoopFsRelation" in plan.relation().getClass().getName()


def located(spark: SparkSession, df: DataFrame, columns: dict[str, str], tag: str) -> DataFrame:
    """The named columns and a locator that tells rows apart, whatever their values.

    `columns` maps new names to columns of `df`. `at_file` is a hash of the file's
    path and `at_row` the row's place in it: the same in every scan. A plan that is
    not a plain file scan is first written to the shared folder.
    """
    if not _reads_files(df):
        df = written(spark, df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items())), tag)
        columns = {new: new for new in columns}
    return df.select(
        *(F.col(f"`{old}`").alias(new) for new, old in columns.items()),
        F.xxhash64("_metadata.file_path").alias("at_file"),
        F.col("_metadata.row_index").alias("at_row"),
    )


def broadcast_if_small(df: DataFrame, rows: int, most_bytes: int = 16 << 20) -> DataFrame:
    """Broadcasts `df` where its counted rows take at most `most_bytes`; the join is the same either way.

    Columns must be numbers or digests: 8 bytes a number, 80 a string or binary.
    """
    width = 16 + sum(80 if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema.fields)
    return F.broadcast(df) if rows * width <= most_bytes else df


def held_out(doc_id: F.Column, folds: int, fold: int) -> F.Column:
    """Whether crc32(doc_id as text) mod `folds` is `fold`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the rows of an Arrow batch, which bounds the memory of Python workers.

    Spark bounds a batch's bytes by spark.sql.execution.arrow.maxBytesPerBatch, 64 MiB unless set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    import sys

    return sys.__dict__.setdefault("_quernstone_cache", {})
