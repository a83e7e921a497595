"""All queries of the engine's own operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import urls
from quernstone.operators import store
from quernstone.plans import records, stores
from quernstone.sources.records import previewed
from quernstone.streaming import sync


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), F.col("event_type").alias("field"), "value", F.col("ts").alias("at"), F.col("event_id").alias("device"))


def url_normalize(spark, d):
    return urls.resolved(_table(spark, d, "pages").select("page_id", "url")).select("page_id", "parts.*").drop("robots_url")


def host_counts(spark, d):
    """How many pages each host has, by scheme."""
    return url_normalize(spark, d).groupBy("scheme", "host").agg(F.count(F.lit(1)).alias("pages"))


def html_preview(spark, d):
    return _table(spark, d, "pages").select("page_id", previewed(F.col("html")).alias("preview"))


def lww_latest(spark, d):
    return store.latest(_log(spark, d)).select("record", "field", "value")


def lww_deleted(spark, d):
    return store.merged_flags(_log(spark, d), "signup")


def sync_watermark(spark, d):
    """Watermarks after an import: one device is ahead already, one is unknown, one stands still."""
    state = spark.createDataFrame([("d0", 1 << 40, "2020"), ("d1", 5, "2020")], sync.STATE)
    rows = _table(spark, d, "events").select("event_id", F.concat(F.lit("d"), F.col("event_id") % 3).alias("file_device"))
    new = sync.not_imported(rows.withColumnRenamed("event_id", "id"), state)
    return sync.advanced(new, state, F.lit("2030"))


QUERIES: dict = {f.__name__: f for f in (url_normalize, host_counts, html_preview, lww_latest, lww_deleted, sync_watermark)}

ORACLE: dict = {
    "url_normalize": stores.URLS_SQL + "SELECT * FROM n",
    "host_counts": stores.URLS_SQL + "SELECT scheme, host, count(*) AS pages FROM n GROUP BY 1, 2",
    "html_preview": "SELECT page_id, CASE WHEN strlen(html) > 200 THEN substring(html, 1, 200) || '...' ELSE html END AS preview FROM pages",
    "lww_latest": "SELECT user_id AS record, event_type AS field, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "lww_deleted": "SELECT user_id AS record, count(*) FILTER (event_type = 'signup') > 0 AND coalesce(max(ts) FILTER (event_type <> 'signup') <= max(ts) FILTER (event_type = 'signup'), true) AS deleted FROM events GROUP BY 1",
    "sync_watermark": "SELECT 'd0' AS device, 1099511627776 AS last_id, '2020' AS last_sync_at UNION ALL SELECT 'd' || event_id % 3, greatest(max(event_id), 5), CASE WHEN max(event_id) > 5 OR event_id % 3 = 2 THEN '2030' ELSE '2020' END FROM events WHERE event_id % 3 > 0 GROUP BY event_id % 3",
}
QUERIES |= records.QUERIES | stores.QUERIES
ORACLE |= records.ORACLE | stores.ORACLE
