"""Change logs between devices: JSON lines out and in, watermarks, merge, the whole cycle, streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators import store

LINE = "id bigint, recipe_id string, field_name string, field_value string, modified_at string, device_id string"
STATE = "device string, last_id bigint, last_sync_at string"
_NEEDED = ("id", "recipe_id", "field_name", "modified_at", "device_id")
#: Fields that a merge sets; lists and structs are never merged.
MERGED = ("title", "description", "notes", "servings", "prep_time_minutes", "cook_time_minutes")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _there(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def lines(spark: SparkSession, folder: str, own: str) -> DataFrame:
    """Rows of `changes-*.jsonl` but the own device's, each once; lines that lack a required key are left out.

    A device's log is a file or, as `exported` writes it, a folder of that name.
    """
    files = f"{folder}/changes-*.jsonl"
    if not _there(spark, files):
        return spark.createDataFrame([], f"{LINE}, file_device string")
    found = _usable(spark.read.schema(LINE).option("mode", "DROPMALFORMED").json(files), own)
    return found.dropDuplicates(["file_device", "id"])


def line_stream(spark: SparkSession, folder: str, own: str) -> DataFrame:
    """As `lines`, continuously: each file once, each (device, id) once, whatever its rows' times."""
    found = _usable(spark.readStream.schema(LINE).json(f"{folder}/changes-*.jsonl"), own)
    return found.dropDuplicates(["file_device", "id"])


def _usable(df: DataFrame, own: str) -> DataFrame:
    df = df.withColumn("file_device", F.regexp_extract(F.col("_metadata.file_path"), r"/changes-([^/]*)\.jsonl(?:/[^/]*)?$", 1))
    for name in _NEEDED:
        df = df.where(F.col(name).isNotNull())
    return df.where(F.col("file_device") != own)


def not_imported(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows above their device's watermark; state: device, last_id, one row per device."""
    joined = rows.join(state.select(F.col("device").alias("file_device"), "last_id"), "file_device", "left")
    return joined.where(F.col("id") > F.coalesce("last_id", F.lit(0))).drop("last_id")


def watermarks(rows: DataFrame, state: DataFrame) -> DataFrame:
    """device, last_id after `rows` are in."""
    both = state.select("device", "last_id").unionByName(rows.select(F.col("file_device").alias("device"), F.col("id").alias("last_id")))
    return both.groupBy("device").agg(F.max("last_id").alias("last_id"))


def advanced(rows: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """device, last_id, last_sync_at after `rows` are in; the time changes only where the watermark rises."""
    both = watermarks(rows, state).join(state.select("device", F.col("last_id").alias("before"), "last_sync_at"), "device", "left")
    risen = F.col("before").isNull() | (F.col("last_id") > F.col("before"))
    return both.select("device", "last_id", F.when(risen, now.cast("string")).otherwise(F.col("last_sync_at")).alias("last_sync_at"))


def pending(log: DataFrame) -> DataFrame:
    return log.where(F.col("synced") == 0).orderBy("id")


def marked(log: DataFrame, upto: int) -> DataFrame:
    return log.withColumn("synced", F.when((F.col("id") <= upto) & (F.col("synced") == 0), 1).otherwise(F.col("synced")))


def exported(log: DataFrame, folder: str, device: str) -> tuple[DataFrame, int]:
    """The log with its pending rows marked, which are appended to the device's JSON lines, and how many they are.

    Lines that are appended twice, as after a failure, are read once.
    """
    found = log.where("synced = 0").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).first()
    if not found["n"]:
        return log, 0
    names = [x.split()[0] for x in LINE.split(", ")]
    rows = log.where("synced = 0").repartitionByRange("id").sortWithinPartitions("id").select(*names)
    rows.write.mode("append").json(f"{folder}/changes-{device}.jsonl")
    return marked(log, found["last"]), found["n"]


def unpivoted(records: DataFrame, fields: list[str], at: Column, device: Column) -> DataFrame:
    """record, field, value, at, device: a row for each found field; arrays and structs as JSON."""
    pairs = [F.struct(F.lit(f).alias("field"), _text(records, f).alias("value")) for f in fields]
    rows = records.select("id", F.explode(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())).alias("p"))
    return rows.select(F.col("id").alias("record"), "p.field", "p.value", at.alias("at"), device.alias("device"))


def _text(df: DataFrame, name: str) -> Column:
    nested = df.schema[name].dataType.typeName() in ("array", "struct", "map")
    return F.to_json(name) if nested else F.col(name).cast("string")


def touched(log: DataFrame, own) -> DataFrame:
    """record: those that some row of another device is about."""
    return log.where(F.col("device") != F.lit(own)).select("record").distinct()


def merged(records: DataFrame, log: DataFrame, now: Column, own, fields: tuple[str, ...] = MERGED, deletion: str = store.DELETION) -> DataFrame:
    """`records` after the merge of `log` (record, field, value, at, device), and `merged`: whether the merge met them.

    Only records with a row of a device other than `own` are met; all rows about them count,
    own ones too. Each field takes its newest value, ties by device; a null one overwrites
    (notes become empty), an absent field leaves its column. Title and description are found
    from then on; the status of other fields stays. A deletion stands unless some field is
    strictly newer, and then changes nothing else. Records that are not there stay away.
    """
    about = log.join(touched(log, own), "record", "left_semi")
    return _applied(records, store.latest(about), now, fields, deletion)


def _applied(records: DataFrame, newest: DataFrame, now: Column, fields: tuple[str, ...], deletion: str) -> DataFrame:
    """`records` after the newest rows (record, field, value, at) of all records that a merge meets."""
    is_deletion = F.col("field") == deletion
    pick = lambda f: F.max(F.when(F.col("field") == f, F.struct("at", "value"))).alias(f"new_{f}")
    wide = newest.groupBy("record").agg(*(pick(f) for f in fields), F.max(F.when(is_deletion, F.col("at"))).alias("gone_at"), F.max(F.when(~is_deletion, F.col("at"))).alias("alive_at"))
    rows = records.join(wide, F.col("id") == F.col("record"), "left")
    hit = F.col("record").isNotNull()
    named = F.col("gone_at").isNotNull()
    gone = named & ~F.coalesce(F.col("alive_at") > F.col("gone_at"), F.lit(False))
    told = {f: hit & ~gone & F.col(f"new_{f}").isNotNull() for f in fields}
    change = {"deleted": F.when(hit & gone, 1).when(hit & named, 0).otherwise(F.col("deleted"))}
    for f in fields:
        value = F.col(f"new_{f}.value").cast("string")
        value = F.coalesce(value, F.lit("")) if f == "notes" else value
        change[f] = F.when(told[f], value.try_cast(records.schema[f].dataType)).otherwise(F.col(f))
        if f in ("title", "description"):
            change[f"{f}_status"] = F.when(told[f], "found").otherwise(F.col(f"{f}_status") if f"{f}_status" in records.columns else None)
    change["updated_at"] = F.when(F.greatest(*told.values(), F.lit(False)), now.cast("string")).otherwise(F.col("updated_at"))
    return rows.select(*(change.get(c, F.col(c)).alias(c) for c in records.columns), hit.alias("merged"))


def as_log(log: DataFrame) -> DataFrame:
    """A store's change log in the columns of a merge."""
    return log.select(F.col("recipe_id").alias("record"), F.col("field_name").alias("field"), F.col("field_value").alias("value"), F.col("modified_at").alias("at"), F.col("device_id").alias("device"))


def imported(log: DataFrame, rows: DataFrame) -> DataFrame:
    """`log` with the rows of other devices, as already sent; their ids go on from the log's."""
    new = rows.withColumn("synced", F.lit(1)).withColumn("seq", F.struct("file_device", "id")).drop("id")
    return store.appended(log, new.withColumn("at", F.lit(0)))


def cycle(spark: SparkSession, tables: store.Store, state: DataFrame, folder: str, device: str, now: Column) -> tuple[store.Store, DataFrame, DataFrame]:
    """One synchronisation: export, import, merge.

    Gives the next store, the next state (device, last_id, last_sync_at) and one row of
    exported, imported and merged.
    """
    log, sent = exported(tables.change_log, folder, device)
    rows = not_imported(lines(spark, folder, device), state)
    log = imported(log, rows)
    met = merged(tables.recipes, as_log(log), now, device)
    counts = met.agg(F.count_if("merged").alias("merged"))
    counts = counts.select(F.lit(sent).cast("bigint").alias("exported"), rows.agg(F.count(F.lit(1))).scalar().alias("imported"), "merged")
    return replace(tables, recipes=met.drop("merged"), change_log=log), advanced(rows, state, now), counts


def status(log: DataFrame, state: DataFrame) -> DataFrame:
    """One row: enabled, pending changes, known devices in order and last sync."""
    nothing = F.lit(None).cast("string")
    rows = log.select((F.col("synced") == 0).alias("open"), nothing.alias("device"), nothing.alias("at"))
    rows = rows.unionByName(state.select(F.lit(False).alias("open"), F.col("device").cast("string").alias("device"), F.col("last_sync_at").cast("string").alias("at")))
    return rows.agg(F.lit(True).alias("enabled"), F.count_if("open").alias("pending"), F.array_sort(F.collect_set("device")).alias("devices"), F.max("at").alias("last_sync_at"))


def _driven(state: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The last rows of a streamed aggregate, until what is there now is read.

    State is one row for each key, in RocksDB without expiry: late rows count. Each batch
    writes the keys that it touched below its own number, so one that is run again replaces
    what it wrote. A later call on the folder goes on from its state.
    """
    spark = state.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    schema = state.schema
    if not _there(spark, f"{folder}/rows/batch=*"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    return store.last_of(rows, keys, "batch").select(*schema.names)


def latest_stream(log: DataFrame, folder: str) -> DataFrame:
    """Last writer wins over a streamed log (record, field, value, at, device): record, field, value, at."""
    return _driven(store.latest(log), ["record", "field"], folder)


def merged_stream(records: DataFrame, log: DataFrame, folder: str, now: Column, own, fields: tuple[str, ...] = MERGED, deletion: str = store.DELETION) -> DataFrame:
    """As `merged` over a streamed log; the state also holds whether another device wrote a field."""
    newest = F.max_by(F.struct("value", "at"), F.struct("at", "device")).alias("v")
    state = log.groupBy("record", "field").agg(newest, F.max(F.col("device") != F.lit(own)).alias("remote"))
    rows = _driven(state, ["record", "field"], folder)
    met = rows.where("remote").select("record").distinct()
    about = rows.join(met, "record", "left_semi").select("record", "field", "v.value", "v.at")
    return _applied(records, about, now, fields, deletion)


def to_fetch(requests: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """The streamed requests (domain, at) whose rules must be fetched: the first of each domain within its time to live.

    The state of a domain goes once the watermark has passed its time, so it is as large as
    the domains of that time.
    """
    return requests.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["domain"])
