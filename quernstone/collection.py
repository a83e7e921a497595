"""A stored collection and its commands, each over whole tables.

Every command that changes something writes all tables that it changes as a new snapshot
below the collection's folder and only then marks it as complete, so that a failure in
between leaves the one before. Commands take and give tables; a single record is a table
of one row.
"""

from __future__ import annotations

from dataclasses import fields as parts_of

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import urls
from quernstone.operators import fetching, fields, robots, store, tagging, versions
from quernstone.sources import interchange, records
from quernstone.streaming import sync

STORE = tuple(f.name for f in parts_of(store.Store))


class Collection:
    """The collection in `folder`, which is made if it is not there. `now` is a column, the current time unless given."""

    def __init__(self, spark: SparkSession, folder: str, device: str | None = None, now: Column | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.device = device or spark.range(1).select(fields.device_id(F.lit(self.folder)).alias("d")).first()["d"]
        self.now = fields.now_text(F.current_timestamp()) if now is None else now
        if not self._numbers():
            tables, found = versions.migrated(spark, {}, spark.createDataFrame([], versions.VERSIONS), self.now)
            self._write(tables | {"schema_version": found})

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Complete snapshots, the oldest first."""
        at, files = self._files(f"{self.folder}/snapshot-*/_COMPLETE")
        return sorted(int(s.getPath().getParent().getName().removeprefix("snapshot-")) for s in files.globStatus(at) or [])

    def _write(self, changed: dict[str, DataFrame]) -> None:
        """The next snapshot: changed tables anew, the others as links to where they are."""
        old = self._places() if self._numbers() else {}
        number = (self._numbers() or [0])[-1] + 1
        root = f"{self.folder}/snapshot-{number:08}"
        for name, df in changed.items():
            df.write.mode("overwrite").parquet(f"{root}/{name}")
        places = [(name, f"{root}/{name}" if name in changed else old[name]) for name in {**old, **changed}]
        self.spark.createDataFrame(places, "name string, place string").coalesce(1).write.mode("overwrite").json(f"{root}/places")
        at, files = self._files(f"{root}/_COMPLETE")
        files.create(at, True).close()

    def _places(self) -> dict[str, str]:
        root = f"{self.folder}/snapshot-{self._numbers()[-1]:08}"
        return {r["name"]: r["place"] for r in self.spark.read.schema("name string, place string").json(f"{root}/places").collect()}  # one row a table

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._places()[name])

    @property
    def tables(self) -> store.Store:
        places = self._places()
        return store.Store(*(self.spark.read.parquet(places[n]) for n in STORE))

    def _keep(self, before: store.Store, after: store.Store, results: DataFrame) -> DataFrame:
        """Writes what changed, results first as they are of the tables before."""
        changed = {n: getattr(after, n) for n in STORE if getattr(after, n) is not getattr(before, n)}
        self._write(changed | {"results": results})
        return self.table("results")

    # Pages.

    def validate_urls(self, requests: DataFrame) -> DataFrame:
        """`requests` (url) with `parts`: the normal form's, or why it is not valid."""
        return urls.resolved(requests)

    def check_robots(self, requests: DataFrame, fetches: DataFrame, now: Column) -> DataFrame:
        """Decisions on `requests` (domain, robots_url, path); the cache takes what `fetches` brought."""
        cache = self.table("robots_cache").withColumn("fetched_at", F.to_timestamp("fetched_at"))
        decided = robots.checked(requests, cache, fetches, now)
        kept = robots.pruned(robots.refreshed(requests, cache, fetches, now), now)
        self._write({"results": decided, "robots_cache": kept.withColumn("fetched_at", fields.now_text(F.col("fetched_at")))})
        return self.table("results")

    def ingest_urls(self, requests: DataFrame, robots_fetches: DataFrame, fetches: DataFrame, now: Column) -> DataFrame:
        cache = self.table("robots_cache").withColumn("fetched_at", F.to_timestamp("fetched_at"))
        return fetching.ingested(requests, cache, robots_fetches, fetches, now)

    def extract(self, pages: DataFrame) -> DataFrame:
        return records.extracted(pages)

    def tag(self, rows: DataFrame, words: tagging.Vocabulary, refine: bool = False) -> DataFrame:
        return tagging.tagged(rows, words, refine)

    def extract_and_tag(self, pages: DataFrame, words: tagging.Vocabulary) -> DataFrame:
        return tagging.tagged_pages(records.extracted(pages), words)

    # Records.

    def save(self, saves: DataFrame) -> DataFrame:
        before = self.tables
        return self._keep(before, *store.saved(before, saves, self.now, self.device))

    def get(self, ids: DataFrame) -> DataFrame:
        return store.looked_up(self.tables, ids)

    def update(self, patches: DataFrame) -> DataFrame:
        before = self.tables
        return self._keep(before, *store.updated(before, patches, self.now, self.device))

    def delete(self, ids: DataFrame) -> DataFrame:
        before = self.tables
        return self._keep(before, *store.soft_deleted(before, ids, self.now, self.device))

    def list(self) -> DataFrame:
        return store.listed(self.tables)

    def search(self, text: str | None = None, **wanted: list[str]) -> DataFrame:
        return store.search(self.tables, text, **wanted)

    # Files.

    def export(self, folder: str, ids: DataFrame | None = None) -> int:
        """Writes the records of `ids`, or all, as one JSON array; how many they are. An id that is not there is an error."""
        found = store.assembled(self.tables) if ids is None else store.looked_up(self.tables, ids)
        if ids is not None and (missing := found.where("error is not null").select("error").limit(1).collect()):
            raise LookupError(missing[0]["error"])
        value = lambda n, name=None: F.col(f"{n}.value").alias(name or n)
        rows = found.select(
            "id", value("title"), value("description"), F.transform("ingredients", lambda i: i["raw_text"]).alias("ingredients"), F.col("ingredients").alias("ingredients_parsed"), "instructions", F.col("prep_time_minutes.value").cast("int").alias("prep"), F.col("cook_time_minutes.value").cast("int").alias("cook"),
            value("servings"), F.col("source_url").alias("url"), value("images"), value("nutrition"), "source", "tags", "notes",
        )
        lines = interchange.exported(rows)
        interchange.written_array(lines, folder)
        return lines.count()

    def import_file(self, path: str) -> DataFrame:
        """One row: imported, updated, skipped and errors."""
        rows = interchange.imported_file(self.spark, path)
        before = self.tables
        after, results = store.saved(before, interchange.as_saves(rows.where("error is null")), self.now, self.device)
        none = F.lit(None)
        bad = rows.where("error is not null").select(F.col("url").alias("source_url"), F.col("at").alias("seq"), none.cast("string").alias("id"), none.cast("boolean").alias("created"), "error")
        return store.outcome(self._keep(before, after, results.unionByName(bad)))

    def backup(self, folder: str) -> dict:
        return interchange.backed_up({n: self.table(n) for n in self._places() if n != "results"}, folder)

    def restore(self, folder: str) -> int:
        """Takes all tables of a snapshot; its count of active records."""
        tables, active = interchange.restored(self.spark, folder, [n for n in self._places() if n != "results"])
        self._write(tables)
        return active

    # Other devices.

    def sync(self, folder: str) -> DataFrame:
        """One row: exported, imported and merged."""
        before = self.tables
        after, state, counts = sync.cycle(self.spark, before, self.table("sync_state"), folder, self.device, self.now)
        self._write({"results": counts, "recipes": after.recipes, "change_log": after.change_log, "sync_state": state})
        return self.table("results")

    def sync_status(self) -> DataFrame:
        return sync.status(self.table("change_log"), self.table("sync_state"))
