"""Schema versions of a set of tables: steps forward, each applied once and recorded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import store

VERSIONS = "version int, applied_at string"
CACHE = "domain string, text string, status string, fetched_at string"
SYNC_STATE = "device string, last_id bigint, last_sync_at string"

Tables = dict[str, DataFrame]


def _first(spark: SparkSession, tables: Tables) -> Tables:
    kinds = {"recipes": store.RECIPES, "ingredients": store.INGREDIENTS, "instructions": store.INSTRUCTIONS, "tags": store.TAGS, "change_log": store.CHANGE_LOG, "sync_state": SYNC_STATE}
    return tables | {name: spark.createDataFrame([], kind) for name, kind in kinds.items()}


def _second(spark: SparkSession, tables: Tables) -> Tables:
    return tables | {"robots_cache": spark.createDataFrame([], CACHE)}


#: Steps to the newest schema; the first has version 1.
STEPS: list[Callable[[SparkSession, Tables], Tables]] = [_first, _second]


def current(versions: DataFrame) -> int:
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def migrated(spark: SparkSession, tables: Tables, versions: DataFrame, now: Column, steps: list = STEPS) -> tuple[Tables, DataFrame]:
    """The tables after every step beyond the highest recorded version, and the versions then; a second call changes nothing."""
    done = current(versions)
    for number, step in enumerate(steps[done:], done + 1):
        tables = step(spark, tables)
        versions = versions.unionByName(spark.range(1).select(F.lit(number).cast("int").alias("version"), now.cast("string").alias("applied_at")))
    return tables, versions
