"""Queries of the record store, the synchronisation and the way from URL to page, with their SQL oracles.

Orders play records, their lines' parts ingredients; a tenth of the records is deleted.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import durations, urls
from quernstone.operators import fetching, fields, robots, store, tagging, versions
from quernstone.sources import interchange
from quernstone.sources.folders import shared
from quernstone.streaming import sync

NOW = "2030-01-01T00:00:00.000000Z"
OWN = "own"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _store(spark, d) -> store.Store:
    key = F.col("o_orderkey")
    value = lambda c, missing, kind="string": F.when(~missing, c).cast(kind)
    state = lambda missing: F.when(missing, "not_found").otherwise("found")
    why = lambda missing, text: F.when(missing, text)
    no_title, no_prep = key % 7 == 0, key % 5 == 0
    at = fields.now_text(F.col("o_orderdate"))
    flat = {
        "id": key.cast("string"),
        "source_url": F.concat(F.lit("http://x/"), key),
        "title": value(F.col("o_orderpriority"), no_title), "title_status": state(no_title), "title_justification": why(no_title, fields.NOT_FOUND),
        "description": F.col("o_orderstatus"), "description_status": F.lit("found"), "description_justification": F.lit(None).cast("string"),
        "servings": F.col("o_custkey").cast("string"), "servings_status": F.lit("found"), "servings_justification": F.lit(None).cast("string"),
        "prep_time_minutes": value(key % 50, no_prep, "bigint"), "prep_time_status": state(no_prep), "prep_time_justification": why(no_prep, fields.UNPARSED),
        "cook_time_minutes": F.lit(None).cast("bigint"), "cook_time_status": F.lit("found"), "cook_time_justification": F.lit(None).cast("string"),
        "images_json": F.concat(F.lit('["i'), key, F.lit('"]')), "images_status": F.lit("found"), "images_justification": F.lit(None).cast("string"),
        "nutrition_json": F.concat(F.lit('{"calories":'), key % 900, F.lit("}")), "nutrition_status": F.lit("found"), "nutrition_justification": F.lit(None).cast("string"),
        "extraction_source": F.lit("json_ld"), "notes": F.lit("n"), "created_at": at, "updated_at": at, "deleted": (key % 10 == 3).cast("int"), "device_id": F.lit("first"),
    }
    recipes = _table(spark, d, "orders").select(*(c.alias(n) for n, c in flat.items()))
    line, part = _table(spark, d, "lineitem"), _table(spark, d, "part")
    owner = F.col("l_orderkey").cast("string").alias("recipe_id")
    ingredients = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(owner, (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("int").alias("position"), F.col("p_name").alias("name"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("unit"), F.col("p_type").alias("raw_text"))
    instructions = line.select(owner, F.col("l_suppkey").cast("int").alias("step_number"), F.col("l_linestatus").alias("text"))
    domain = F.element_at(F.array(*map(F.lit, store.DOMAINS)), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("domain")
    tags = line.groupBy(owner, domain, F.col("l_returnflag").alias("label")).agg((F.max("l_discount") * 10).alias("confidence"))
    log = _table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("recipe_id"),
        F.element_at(F.create_map(*(F.lit(x) for x in ("click", "title", "view", "description", "error", "notes", "purchase", "servings", "signup", store.DELETION))), F.col("event_type")).alias("field_name"),
        F.when(F.col("event_id") % 4 > 0, F.col("value").cast("string")).alias("field_value"),
        fields.now_text(F.col("ts")).alias("modified_at"),
        F.when(F.col("event_id") % 3 == 0, OWN).otherwise(F.concat(F.lit("d"), F.col("event_id") % 3)).alias("device_id"),
        F.lit(0).alias("synced"),
    )
    return store.Store(recipes, ingredients, instructions, tags, log.where("field_name is not null"))


def _set_text(tags) -> F.Column:
    one = lambda dom: F.array_join(F.transform(tags[dom], lambda t: F.concat(t["label"], F.lit("="), F.round(t["confidence"] * 100).cast("int"))), ",")
    return F.concat_ws("|", *(one(x) for x in store.DOMAINS))


def list_active(spark, d):
    """Summaries of active records with their tags, newest first."""
    return store.listed(_store(spark, d)).select("id", "source_url", "title", "description", "prep_time_minutes", "created_at", "updated_at", _set_text(F.col("tags")).alias("tags"))


def record_lookup(spark, d):
    """Whole records of the asked ids; ids of deleted and unknown records are errors."""
    ids = _table(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("no-"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("id"))
    found = store.looked_up(_store(spark, d), ids)
    return found.select(
        "id", F.col("title.status").alias("title_status"), F.col("title.value").alias("title"), F.col("title.justification").alias("title_justification"), F.col("cook_time_minutes.value").alias("cook"), F.col("images.value")[0].alias("image"),
        F.col("nutrition.value.calories").alias("calories"), F.array_join(F.transform("ingredients", lambda i: i["name"]), ",").alias("ingredients"), F.array_join(F.transform("instructions", lambda s: s["text"]), "").alias("steps"), F.when(F.col("error").isNull(), _set_text(F.col("tags"))).alias("tags"), "error",
    )


def search_text(spark, d):
    """Active records whose title, or one of whose ingredients' names, holds the text; _ is any character."""
    return store.search(_store(spark, d), "URG_N").select("id", "title")


def search_tags(spark, d):
    return store.search(_store(spark, d), cuisine=["A", "N"]).select("id", "title")


def search_combined(spark, d):
    """Text and labels of two domains together."""
    return store.search(_store(spark, d), "wid%t", cuisine=["A"], diet=["N"]).select("id", "title", _set_text(F.col("tags")).alias("tags"))


def soft_delete(spark, d):
    """The store after deletion of some records, active and already deleted ones."""
    tables = _store(spark, d)
    ids = _table(spark, d, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").cast("string").alias("id"))
    after, _ = store.soft_deleted(tables, ids, F.lit(NOW), OWN)
    return after.recipes.select("id", "deleted", "updated_at", "device_id")


def soft_delete_results(spark, d):
    """Whether each asked record was active, and how many changes its deletion logged."""
    tables = _store(spark, d)
    tables = replace(tables, change_log=tables.change_log.limit(0))
    ids = _table(spark, d, "orders").where("o_orderkey % 9 = 0").select(F.concat(F.when(F.col("o_orderkey") % 18 == 0, "no-").otherwise(""), "o_orderkey").alias("id"))
    after, results = store.soft_deleted(tables, ids, F.lit(NOW), OWN)
    logged = after.change_log.where(F.col("field_name") == store.DELETION).groupBy(F.col("recipe_id").alias("id")).agg(F.count(F.lit(1)).alias("logged"))
    return results.join(logged, "id", "left").select("id", "deleted", F.coalesce("logged", F.lit(0)).alias("logged"))


def _saves(spark, d) -> DataFrame:
    """Parts as saves: each URL is saved twice; a third of the URLs are those of records."""
    key = F.col("p_partkey")
    twin = key + 1 - key % 2
    url = F.concat(F.when(twin % 3 == 0, "http://x/").otherwise("http://new/"), twin)
    tag = F.struct(F.col("p_brand").alias("label"), (F.col("p_size") / 25).alias("confidence"))
    none = F.array().cast(f"array<{store.TAG}>")
    part = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("name"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("string").alias("unit"), w.alias("raw_text")))
    return _table(spark, d, "part").select(
        url.alias("source_url"), key.alias("seq"), fields.field(F.col("p_name")).alias("title"), fields.field(F.lit(None).cast("string")).alias("description"), fields.field(F.col("p_brand")).alias("servings"),
        fields.field(F.col("p_size").cast("bigint")).alias("prep_time_minutes"), fields.field(F.lit(None).cast("bigint"), fields.UNPARSED).alias("cook_time_minutes"), fields.field(F.array("p_type")).alias("images"),
        fields.field(F.lit(None).cast(store.NUTRITION), fields.NOT_PROVIDED).alias("nutrition"), F.lit("microdata").alias("source"), part.alias("ingredients"), F.array(F.struct(F.lit(1).alias("step_number"), F.col("p_type").alias("text"))).alias("instructions"),
        F.struct(F.array(tag, F.struct(F.lit("x").alias("label"), F.lit(0.5).alias("confidence"))).alias("cuisine"), F.array(tag, F.struct(F.col("p_brand").alias("label"), F.lit(0.25).alias("confidence"))).alias("course"), none.alias("diet")).alias("tags"),
    )


def save_children(spark, d):
    """The store after saves: records with their new children, the others as they were."""
    after, _ = store.saved(_store(spark, d), _saves(spark, d), F.lit(NOW), OWN)
    r = store.assembled(after)
    texts = F.array_join(F.transform("ingredients", lambda i: i["name"]), ",")
    return r.select("source_url", F.col("title.value").alias("title"), F.col("cook_time_minutes.justification").alias("cook_why"), "notes", "created_at", "updated_at", "source", texts.alias("ingredients"), F.size("instructions").alias("steps"), _set_text(F.col("tags")).alias("tags"))


def save_outcome(spark, d):
    """Counts of created and updated records and of errors."""
    _, results = store.saved(_store(spark, d), _saves(spark, d), F.lit(NOW), OWN)
    row = store.outcome(results)
    return row.select("imported", "updated", "skipped", F.size("errors").alias("errors"), F.element_at("errors", 1).alias("first_error"))


def save_log(spark, d):
    """The changes that saves log: a row for each found field and each list."""
    tables = _store(spark, d)
    after, _ = store.saved(replace(tables, change_log=tables.change_log.limit(0)), _saves(spark, d), F.lit(NOW), OWN)
    return after.change_log.groupBy("field_name", "synced").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(F.when(F.col("field_name") != "tags", F.col("field_value"))).alias("least"))


def update_fields(spark, d):
    """The store after patches of some fields; records that are deleted or not there are errors."""
    key = F.col("c_custkey")
    patches = _table(spark, d, "customer").select(key.cast("string").alias("id"), F.when(key % 2 == 0, F.col("c_name")).alias("title"), F.when(key % 3 == 0, key).alias("cook_time_minutes"), F.when(key % 5 == 0, F.col("c_mktsegment")).alias("notes"), F.when(key % 4 == 0, F.array(F.struct(F.lit(1).alias("step_number"), F.lit("stir").alias("text")))).alias("instructions"))
    after, results = store.updated(_store(spark, d), patches, F.lit(NOW), OWN)
    steps = after.instructions.groupBy(F.col("recipe_id").alias("id")).agg(F.count(F.lit(1)).alias("steps"))
    rows = after.recipes.join(results.select("id", "error"), "id", "left").join(steps, "id", "left")
    return rows.select("id", "title", "title_status", "title_justification", "cook_time_minutes", "cook_time_status", "notes", "updated_at", "device_id", F.coalesce("steps", F.lit(0)).alias("steps"), "error")


def field_round_trip(spark, d):
    """Flat columns to field structs, to tagged JSON and back to flat columns."""
    rows = store.active(_store(spark, d).recipes).select("id", *store.struct_fields())
    kinds = {n: kind for n, _, kind in store.FIELDS}
    back = rows.select("id", *(fields.untagged(fields.tagged(F.col(n)), kinds[n]).alias(n) for n in kinds))
    title = fields.tagged(F.col("title"))
    return back.select("id", title.alias("title_json"), *store.flat_fields(F.col)).select("id", "title_json", "title", "title_status", "title_justification", "prep_time_minutes", "prep_time_justification", "cook_time_minutes", "images_json", "nutrition_json")


def tag_round_trip(spark, d):
    """Tag rows to tag sets and back."""
    sets = store.tag_sets(_store(spark, d).tags)
    return store.tag_rows(sets, "recipe_id").select("recipe_id", "domain", "label", F.round("confidence", 6).alias("confidence"))


_URLS = ["", "  ", "example.com/a", "ftp://example.com/a", "http://", "http://a b/", "http://x:99999/", "HTTP://U:P@Example.COM:80/a/./b/../c//?q=1 2#f g", "https://bücher.example/ä", "http://0x7f.1/", "http://[::1]:8080/x/", "://x", "http://ex.org/%7Ea/?#", "http://ex.org:8080/a?b=c#d"]
_URL_FOUND = [
    ("", None, "No URL provided"), ("", None, "No URL provided"), ("", None, "Invalid URL: missing scheme (try adding http:// or https://)"), ("", None, "Invalid URL: scheme 'ftp' not allowed (only http and https)"),
    ("", None, "Invalid URL: empty host"), ("", None, "Invalid URL: invalid domain character"), ("", None, "Invalid URL: invalid port number"), ("http://example.com/a/c/?q=1%202#f%20g", None, None),
    ("https://xn--bcher-kva.example/%C3%A4", None, None), ("http://127.0.0.1/", None, None), ("http://[::1]:8080/x", 8080, None), ("", None, "Invalid URL: relative URL without a base"), ("http://ex.org/%7Ea?#", None, None), ("http://ex.org:8080/a?b=c#d", 8080, None),
]


def url_validate(spark, d):
    """Normal form or error of odd URLs, dealt over the pages."""
    url = F.element_at(F.array(*map(F.lit, _URLS)), (F.col("page_id") % len(_URLS) + 1).cast("int"))
    rows = _table(spark, d, "pages").select("page_id", url.alias("url"))
    return urls.resolved(rows).select("page_id", "parts.normalized", "parts.port", "parts.error")


def robots_urls(spark, d):
    """Where the crawl rules of each page's site are, with the host that keys their cache."""
    return urls.resolved(_table(spark, d, "pages").select("page_id", "url")).select("page_id", F.col("parts.host").alias("domain"), "parts.robots_url")


_RULES = "User-agent: *\nDisallow: /private\nCrawl-delay: 2"


def _robots_tables(spark, d):
    """Requests, cache and fetches by nation: fresh, old, no entry; found, missing, failing or no fetch."""
    key = F.col("n_nationkey")
    host = F.concat(F.lit("h"), key, F.lit(".example"))
    nation = _table(spark, d, "nation")
    requests = nation.select(key.alias("key"), host.alias("domain"), F.concat(F.lit("http://"), host, F.lit("/robots.txt")).alias("robots_url"), F.when(key % 2 == 0, "/private/a").otherwise("/b").alias("path"))
    hours = F.when(key % 3 == 0, 1).otherwise(30)
    cache = nation.where("n_nationkey % 3 < 2").select(host.alias("domain"), F.lit("").alias("text"), F.lit("ok").alias("status"), (F.lit("2030-01-02").cast("timestamp") - F.make_interval(hours=hours)).alias("fetched_at"))
    fetches = nation.where("n_nationkey % 5 < 4").select(F.concat(F.lit("http://"), host, F.lit("/robots.txt")).alias("robots_url"), F.element_at(F.array(F.lit(200), F.lit(404), F.lit(503), F.lit(200)), key % 5 + 1).alias("code"), F.when(key % 5 == 0, _RULES).otherwise("").cast("binary").alias("body"))
    return requests, cache, fetches


def robots_policy(spark, d):
    """Decision, reason, delay and source by cache and fetch."""
    requests, cache, fetches = _robots_tables(spark, d)
    now = F.lit("2030-01-02").cast("timestamp")
    return robots.checked(requests, cache, fetches, now).select("key", "allowed", "reason", "delay", "source")


def robots_refresh(spark, d):
    """The cache after the requests, without entries older than a day and a bit."""
    requests, cache, fetches = _robots_tables(spark, d)
    now = F.lit("2030-01-02").cast("timestamp")
    return robots.pruned(robots.refreshed(requests, cache, fetches, now), now, 1).select("domain", "status", F.length("text").alias("n"), ((F.unix_timestamp(now) - F.unix_timestamp("fetched_at")) / 3600).cast("int").alias("hours"))


def cache_times(spark, d):
    """Freshness by the exact and by the rough reckoning, and pruning by text, at the edges of months."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey") * 15)
    text = F.concat(day.cast("string"), F.lit("T06:00:00.000000Z"))
    now = F.concat(F.date_add(day, 1).cast("string"), F.lit("T05:00:00.000000Z"))
    rows = _table(spark, d, "nation").select("n_nationkey", text.alias("fetched_at"), now.alias("now"))
    kept = robots.pruned_by_text(rows, F.concat(F.substring("now", 1, 10), F.lit("T23:00:00.000000Z")), 1).select("n_nationkey", F.lit(True).alias("kept"))
    at = lambda c: F.to_timestamp(F.substring(c, 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.join(kept, "n_nationkey", "left").select("n_nationkey", robots.rough_seconds(F.col("fetched_at")).alias("rough"), robots.fresh(at("fetched_at"), at("now")).alias("fresh"), robots.roughly_fresh(F.col("fetched_at"), F.col("now")).alias("roughly"), F.coalesce("kept", F.lit(False)).alias("kept"))


def _fetches(spark, d) -> DataFrame:
    key = F.col("page_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (key % 12 + 1).cast("int"))
    return _table(spark, d, "pages").select(
        "page_id", "url",
        F.when(key % 12 < 5, F.lit(None)).otherwise(pick(0, 0, 0, 0, 0, 404, 418, 503, 200, 200, 200, 200)).cast("int").alias("code"),
        pick(None, None, None, None, None, None, None, None, "text/plain", "text/html; charset=utf-8", None, "text/html").cast("string").alias("content_type"),
        F.when(key % 12 == 9, 10_485_761).cast("bigint").alias("content_length"),
        F.when(key % 24 == 23, F.unhex(F.lit("FF"))).otherwise(F.col("html").cast("binary")).alias("body"),
        F.concat("url", F.when(key % 12 == 11, "/moved").otherwise("")).alias("final_url"),
        pick("slow", "refused", "DNS failure", "no such host x", "odd", *[None] * 7).cast("string").alias("failure"),
        pick("timeout", "connect", *[None] * 10).cast("string").alias("failure_kind"),
    )


def fetch_errors(spark, d):
    """Kind and message of every refused page."""
    return fetching.accepted(_fetches(spark, d)).select("page_id", F.col("error.error_type").alias("error_type"), F.col("error.message").alias("message"), F.col("error.details").alias("details"), F.col("error.max_bytes").alias("max_bytes"), "status_code", F.col("final_url").isNotNull().alias("moved"))


def ingest(spark, d):
    """From URL to page: invalid ones, ones that crawl rules disallow, refused and good ones."""
    pages = _fetches(spark, d)
    fetches = urls.resolved(pages).withColumn("url", F.col("parts.normalized")).groupBy("url").agg(F.max_by(F.struct(*(c for c in pages.columns if c not in ("url", "page_id"))), "page_id").alias("f")).select("url", "f.*")
    requests = pages.select(F.when(F.col("page_id") % 10 == 0, F.lit("nowhere")).otherwise(F.col("url")).alias("url")).distinct()
    hosts = urls.resolved(pages.select("url")).select("parts.host", "parts.robots_url").distinct()
    robots_fetches = hosts.select("robots_url", F.lit(200).alias("code"), F.when(F.col("host").endswith(".org"), "User-agent: *\nDisallow: /en").otherwise("").cast("binary").alias("body"))
    cache = spark.createDataFrame([], "domain string, text string, status string, fetched_at timestamp")
    done = fetching.ingested(requests, cache, robots_fetches, fetches, F.lit("2030-01-02").cast("timestamp"))
    return done.groupBy(F.coalesce("error.error_type", F.lit("ok")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first"))


def _remote(spark, d, folder: str) -> tuple[store.Store, int]:
    """The store with own rows only; the other devices' rows as JSON lines below `folder`."""
    tables = _store(spark, d)
    for device in ("d1", "d2"):
        sync.exported(tables.change_log.where(F.col("device_id") == device), folder, device)
    return replace(tables, change_log=tables.change_log.where(F.col("device_id") == OWN))


def sync_cycle(spark, d):
    """Records after export, import and merge."""
    folder = shared(spark, "sync")
    tables = _remote(spark, d, folder)
    state = spark.createDataFrame([("d1", 20, "2020")], sync.STATE)
    after, _, _ = sync.cycle(spark, tables, state, folder, OWN, F.lit(NOW))
    return after.recipes.select("id", "title", "title_status", "description", "description_status", "notes", "servings", "deleted", "updated_at")


def sync_counts(spark, d):
    """What two cycles in a row export, import and merge, and the state after them."""
    folder = shared(spark, "sync")
    state = spark.createDataFrame([("d1", 20, "2020")], sync.STATE)
    after, state, first = sync.cycle(spark, _remote(spark, d, folder), state, folder, OWN, F.lit(NOW))
    _, state, second = sync.cycle(spark, after, state, folder, OWN, F.lit("2031"))
    marks = state.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "device", "last_id", "last_sync_at"))), ",").alias("marks"))
    return first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2))).withColumn("marks", marks.scalar())


def file_import(spark, d):
    """Records out to one JSON array file, in again as saves into an empty store, and what is in it then."""
    folder = shared(spark, "export")
    out = store.assembled(_store(spark, d)).where("cast(id as bigint) % 40 = 1")
    rows = out.select(
        "id", F.col("title.value").alias("title"), F.col("description.value").alias("description"), F.transform("ingredients", lambda i: i["raw_text"]).alias("ingredients"), F.col("ingredients").alias("ingredients_parsed"), "instructions", F.col("prep_time_minutes.value").cast("int").alias("prep"),
        F.col("cook_time_minutes.value").cast("int").alias("cook"), F.col("servings.value").alias("servings"), F.col("source_url").alias("url"), F.col("images.value").alias("images"), F.col("nutrition.value").alias("nutrition"), "source", "tags", "notes",
    )
    interchange.written_array(interchange.exported(rows), folder)
    tables, _ = versions.migrated(spark, {}, spark.createDataFrame([], versions.VERSIONS), F.lit(NOW))
    empty = store.Store(*(tables[n] for n in ("recipes", "ingredients", "instructions", "tags", "change_log")))
    after, _ = store.saved(empty, interchange.as_saves(interchange.imported_file(spark, folder).where("error is null")), F.lit(NOW), OWN)
    r = store.assembled(after)
    return r.select("source_url", F.col("title.value").alias("title"), F.col("title.justification").alias("title_why"), F.col("prep_time_minutes.value").alias("prep"), F.col("nutrition.value.calories").alias("calories"), F.size("ingredients").alias("n_ingredients"), F.array_join(F.transform("ingredients", lambda i: i["name"]), ",").alias("ingredients"), _set_text(F.col("tags")).alias("tags"))


def times(spark, d):
    """Times, days, scores and first numbers in text."""
    n = F.col("p_size")
    text = F.concat(F.lit("  "), n, F.when(F.col("p_partkey") % 2 == 0, ".5").otherwise(""), F.lit(" g"))
    at = F.lit("1970-01-01").cast("timestamp") + F.make_interval(days=n, secs=F.lit(0.25))
    return _table(spark, d, "part").select("p_partkey", fields.now_text(at).alias("at"), fields.day_of(n).cast("string").alias("day"), fields.clamped(n / 25).alias("clamped"), fields.normal_score(n.cast("double"), F.col("p_partkey") % 3 * 10).alias("score"), durations.first_count(text).alias("count"), durations.first_float(text).alias("amount"))


WORDS = tagging.Vocabulary(
    [("widget", ["widget"], ["cold", "widget"], ["econ"]), ("small", ["small"], ["small", "widget"], ["standard"]), ("Chinese", ["gear"], ["gear", "hot"], [])],
    [("snack", ["widget", "gear"], ["hot", "gear", "widget"], ["econ"]), ("main", ["ring"], ["ring", "small"], ["standard"])],
    {"hot gear": "milk", "ring": "wheat", "cold": "ice"},
    {"milk": ["ContainsDairy", "HighFat"], "wheat": ["ContainsGluten"], "ice": [], "small": []},
)


def _tag_text(tags) -> F.Column:
    one = lambda dom: F.array_join(F.transform(tags[dom], lambda t: F.concat(t["label"], F.lit("="), F.round(t["confidence"] * 1000).cast("int"))), ",")
    return F.concat_ws("|", *(one(x) for x in store.DOMAINS))


def _dishes(spark, d) -> DataFrame:
    title = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, " dim sum").otherwise(""))
    parts = F.when(F.col("p_partkey") % 5 > 0, F.split(F.concat(F.lit("hot "), "p_name"), " ")).otherwise(F.array().cast("array<string>"))
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), title.alias("title"), F.col("p_brand").alias("description"), parts.alias("ingredients"), F.array("p_type").alias("instructions"))


def tag_sets(spark, d):
    """The tags of all three domains, within the row."""
    return tagging.tagged(_dishes(spark, d), WORDS).select("id", _tag_text(F.col("tags")).alias("tags"))


def refine(spark, d):
    """As `tag_sets`, with cuisines and courses refined."""
    return tagging.tagged(_dishes(spark, d), WORDS, refine=True).select("id", _tag_text(F.col("tags")).alias("tags"))


def ingredient_normal(spark, d):
    """Canonical names of ingredients written with prefixes."""
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Organic ", " boneless skinless ", "", "Pure fresh "))), (F.col("p_partkey") % 4 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "Hot Gear").otherwise(F.col("p_name")))
    return _table(spark, d, "part").select("p_partkey", tagging.canonical_part(name, WORDS.aliases).alias("name"))


QUERIES: dict = {f.__name__: f for f in (list_active, record_lookup, search_text, search_tags, search_combined, soft_delete, soft_delete_results, save_children, save_outcome, save_log, update_fields, field_round_trip, tag_round_trip, url_validate, robots_urls, robots_policy, robots_refresh, cache_times, fetch_errors, ingest, sync_cycle, sync_counts, file_import, times, tag_sets, refine, ingredient_normal)}

_BASE = f"""
WITH r AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS id, 'http://x/' || o_orderkey AS source_url, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS title, o_orderstatus AS description,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 50 END AS prep, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS made, (o_orderkey % 10 = 3)::INT AS deleted FROM orders),
i AS (SELECT l_orderkey::VARCHAR AS id, string_agg(p_name, ',' ORDER BY l_partkey * 10 + l_linenumber) AS names, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
s AS (SELECT l_orderkey::VARCHAR AS id, string_agg(l_linestatus, '' ORDER BY l_suppkey, l_linestatus) AS steps, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey::VARCHAR AS id, (['cuisine', 'course', 'diet'])[l_linenumber % 3 + 1] AS domain, l_returnflag AS label, least(greatest(max(l_discount) * 10, 0), 1) AS confidence FROM lineitem GROUP BY 1, 2, 3),
h AS (SELECT id, domain, string_agg(label || '=' || round(confidence * 100)::INT, ',' ORDER BY confidence DESC, label) AS t FROM g GROUP BY 1, 2),
t AS (SELECT id, coalesce(max(t) FILTER (domain = 'cuisine'), '') || '|' || coalesce(max(t) FILTER (domain = 'course'), '') || '|' || coalesce(max(t) FILTER (domain = 'diet'), '') AS tags FROM h GROUP BY 1),
p AS (SELECT *, p_partkey + 1 - p_partkey % 2 AS twin, CASE WHEN (p_partkey + 1 - p_partkey % 2) % 3 = 0 THEN 'http://x/' ELSE 'http://new/' END || (p_partkey + 1 - p_partkey % 2) AS url FROM part),
q AS (SELECT p.*, r.id AS old, r.made AS old_made, coalesce(r.deleted, 0) AS gone FROM p LEFT JOIN r ON r.source_url = p.url),
-- the log that the merge sees: own rows, and others' beyond the watermark
e AS (SELECT event_id, user_id::VARCHAR AS id, CASE event_type WHEN 'click' THEN 'title' WHEN 'view' THEN 'description' WHEN 'error' THEN 'notes' WHEN 'purchase' THEN 'servings' WHEN 'signup' THEN '__deleted' END AS field,
 CASE WHEN event_id % 4 > 0 THEN value::VARCHAR END AS v, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS tm, CASE event_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'd1' ELSE 'd2' END AS device FROM events),
l AS (SELECT * FROM e WHERE field IS NOT NULL AND (device <> 'd1' OR event_id > 20)),
n AS (SELECT id, field, arg_max({{'v': v}}, (tm, device)) AS s, max(tm) AS tm FROM l WHERE id IN (SELECT id FROM l WHERE device <> 'own') GROUP BY 1, 2),
m AS (SELECT id, max(tm) FILTER (field = '__deleted') AS gone_at, max(tm) FILTER (field <> '__deleted') AS alive_at, """ + ", ".join(f"any_value(s) FILTER (field = '{f}') AS {f}" for f in ("title", "description", "notes", "servings")) + """ FROM n GROUP BY 1),
w AS (SELECT *, gone_at IS NOT NULL AND NOT coalesce(alive_at > gone_at, false) AS gone FROM m)
"""
_ERROR = "Failed to insert recipe: UNIQUE constraint failed: recipes.source_url"
_SUMMARY = f"SELECT r.id, source_url, title, description, prep AS prep_time_minutes, made AS created_at, made AS updated_at, coalesce(t.tags, '||') AS tags FROM r LEFT JOIN t USING (id) WHERE deleted = 0"
_VOC = lambda words: ", ".join(f"({i}, '{n}', {t}::VARCHAR[], {p}::VARCHAR[], {s}::VARCHAR[])" for i, (n, t, p, s) in enumerate(words))
_OUT = ", ".join(f"({i}, '{n}', {x})" for i, (n, x) in enumerate(tagging.DIETS))
_DISHES = f"""
WITH d AS (SELECT p_partkey AS id, lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' dim sum' ELSE '' END) AS title, lower(p_brand) AS about, CASE WHEN p_partkey % 5 > 0 THEN string_split('hot ' || lower(p_name), ' ') ELSE []::VARCHAR[] END AS parts, lower(p_type) AS steps FROM part),
cv(ord, label, t, p, s) AS (VALUES {_VOC(WORDS.cuisines)}), kv(ord, label, t, p, s) AS (VALUES {_VOC(WORDS.courses)}), dv(ord, label, outs) AS (VALUES {_OUT}),
c0 AS (SELECT id, ord, label, title, parts, 0.35 * (len(list_filter(t, lambda w: contains(title, w))) > 0)::INT + 0.35 * least(len(list_filter(p, lambda w: len(list_filter(parts, lambda x: contains(x, w))) > 0)) / 2.0, 1) + 0.30 * least(len(list_filter(s, lambda w: contains(steps, w))), 1) AS c FROM d, cv),
k0 AS (SELECT id, ord, label, title, 0.40 * (len(list_filter(t, lambda w: contains(title, w))) > 0)::INT + 0.25 * least(len(list_filter(p, lambda w: len(list_filter(parts, lambda x: contains(x, w))) > 0)) / 2.0, 1) + 0.20 * (len(list_filter(t, lambda w: contains(about, w))) > 0)::INT + 0.15 * least(len(list_filter(s, lambda w: contains(title || ' ' || about || ' ' || steps, w))), 1) AS c FROM d, kv),
u AS (SELECT id, len(list_filter(parts, lambda x: x NOT IN ('ring', 'cold', 'small', 'wheat', 'ice', 'milk'))) AS unknown, list_contains(parts, 'ring') AS gluten, len(parts) AS n FROM d),
x0 AS (SELECT id, ord, label, 1 - 0.2 * unknown AS c FROM u, dv WHERE n > 0 AND unknown <= 2 AND NOT (gluten AND list_contains(outs, 'ContainsGluten'))),
c1 AS (SELECT *, CASE WHEN contains(title, lower(label)) AND contains(array_to_string(parts, ' '), lower(label)) THEN least(c * 1.2, 1) ELSE c END AS c2 FROM c0 WHERE c >= 0.5),
k1 AS (SELECT *, CASE WHEN label IN ('appetizer', 'snack') AND contains(title, 'dim sum') AND id IN (SELECT id FROM c1 WHERE label = 'Chinese') THEN least(c * 1.2, 1) ELSE c END AS c2 FROM k0 WHERE c >= 0.5)
"""


def _sets_sql(value: str) -> str:
    one = lambda table, v: f"SELECT id, string_agg(label || '=' || round({v} * 1000)::INT, ',' ORDER BY round({v}, 9) DESC, ord) AS t FROM {table} GROUP BY 1"
    return _DISHES + f"SELECT d.id, coalesce(a.t, '') || '|' || coalesce(b.t, '') || '|' || coalesce(x.t, '') AS tags FROM d LEFT JOIN ({one('c1', value)}) a USING (id) LEFT JOIN ({one('k1', value)}) b USING (id) LEFT JOIN ({one('x0', 'c')}) x USING (id)"


_P = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
URLS_SQL = f"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, {_P}, 1)) AS scheme, lower(regexp_extract(url, {_P}, 2)) AS host, regexp_extract(url, {_P}, 3) AS pt,
 regexp_replace(CASE WHEN regexp_extract(url, {_P}, 4) = '' THEN '/' ELSE regexp_extract(url, {_P}, 4) END, '(.)/$', '\\1') AS path FROM pages),
q AS (SELECT *, CASE WHEN pt = '' OR (scheme = 'http' AND pt = '80') OR (scheme = 'https' AND pt = '443') THEN NULL ELSE try_cast(pt AS INTEGER) END AS port,
 CASE WHEN regexp_matches(url, '^[^#]*\\?') THEN regexp_extract(url, {_P}, 5) END AS query, CASE WHEN contains(url, '#') THEN regexp_extract(url, {_P}, 6) END AS fragment FROM p),
n AS (SELECT page_id, scheme, host, port, path, query, fragment, scheme || '://' || host || coalesce(':' || port, '') || path || coalesce('?' || query, '') || coalesce('#' || fragment, '') AS normalized, NULL AS error FROM q)
"""
_FETCHED = """
SELECT page_id, url, page_id % 12 AS m, CASE WHEN page_id % 12 < 5 THEN 'network' WHEN page_id % 12 < 8 THEN 'http' WHEN page_id % 12 IN (8, 10) OR page_id % 24 = 23 THEN 'content_type' WHEN page_id % 12 = 9 THEN 'size' END AS kind FROM pages
"""
_ROBOTS = """
WITH n AS (SELECT n_nationkey AS key, 'h' || n_nationkey || '.example' AS domain, n_nationkey % 3 AS c, n_nationkey % 5 AS f FROM nation),
d AS (SELECT *, CASE WHEN c = 0 THEN 'cached' WHEN c = 1 AND f IN (2, 4) THEN 'stale' ELSE 'fresh' END AS kind FROM n)
"""
_VALID = ", ".join("({}, {}, {}, {})".format(i, "NULL" if e else f"'{u}'", "NULL" if p is None else p, "NULL" if not e else "'" + e.replace("'", "''") + "'") for i, (u, p, e) in enumerate(_URL_FOUND))
_HOST = r"'^([A-Za-z]+)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?'"
ORACLE: dict = {
    "list_active": _BASE + _SUMMARY,
    "record_lookup": _BASE + """, ids AS (SELECT CASE WHEN c_custkey % 4 = 1 THEN 'no-' || c_custkey ELSE c_custkey::VARCHAR END AS id FROM customer), a AS (SELECT * FROM r WHERE deleted = 0)
SELECT ids.id, CASE WHEN a.id IS NULL THEN NULL WHEN title IS NULL THEN 'not_found' ELSE 'found' END AS title_status, title, CASE WHEN a.id IS NOT NULL AND title IS NULL THEN 'Not found in source' END AS title_justification, CASE WHEN a.id IS NOT NULL THEN 0 END::BIGINT AS cook,
 CASE WHEN a.id IS NOT NULL THEN 'i' || k END AS image, k % 900 AS calories, CASE WHEN a.id IS NOT NULL THEN coalesce(i.names, '') END AS ingredients, CASE WHEN a.id IS NOT NULL THEN coalesce(s.steps, '') END AS steps, CASE WHEN a.id IS NOT NULL THEN coalesce(t.tags, '||') END AS tags,
 CASE WHEN a.id IS NULL THEN 'Recipe not found: ' || ids.id END AS error FROM ids LEFT JOIN a ON a.id = ids.id LEFT JOIN i ON i.id = a.id LEFT JOIN s ON s.id = a.id LEFT JOIN t ON t.id = a.id""",
    "search_text": _BASE + "SELECT id, title FROM r WHERE deleted = 0 AND (title ILIKE '%urg_n%' OR id IN (SELECT l_orderkey::VARCHAR FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name ILIKE '%urg_n%'))",
    "search_tags": _BASE + "SELECT id, title FROM r WHERE deleted = 0 AND id IN (SELECT id FROM g WHERE domain = 'cuisine' AND label = 'A') AND id IN (SELECT id FROM g WHERE domain = 'cuisine' AND label = 'N')",
    "search_combined": _BASE + "SELECT r.id, title, t.tags FROM r JOIN t USING (id) WHERE deleted = 0 AND (title ILIKE '%wid%t%' OR r.id IN (SELECT l_orderkey::VARCHAR FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name ILIKE '%wid%t%')) AND r.id IN (SELECT id FROM g WHERE domain = 'cuisine' AND label = 'A') AND r.id IN (SELECT id FROM g WHERE domain = 'diet' AND label = 'N')",
    "soft_delete": _BASE + f"SELECT id, CASE WHEN k % 9 = 0 THEN 1 ELSE deleted END AS deleted, CASE WHEN k % 9 = 0 AND deleted = 0 THEN '{NOW}' ELSE made END AS updated_at, CASE WHEN k % 9 = 0 AND deleted = 0 THEN 'own' ELSE 'first' END AS device_id FROM r",
    "soft_delete_results": _BASE + "SELECT CASE WHEN k % 18 = 0 THEN 'no-' ELSE '' END || k AS id, k % 18 <> 0 AND deleted = 0 AS deleted, (k % 18 <> 0 AND deleted = 0)::BIGINT AS logged FROM r WHERE k % 9 = 0",
    "save_children": _BASE + f"""SELECT r.source_url, title, NULL AS cook_why, 'n' AS notes, r.made AS created_at, r.made AS updated_at, 'json_ld' AS source, coalesce(i.names, '') AS ingredients, coalesce(s.n, 0)::INT AS steps, coalesce(t.tags, '||') AS tags
 FROM r LEFT JOIN i USING (id) LEFT JOIN s USING (id) LEFT JOIN t USING (id) WHERE deleted = 0 AND source_url NOT IN (SELECT url FROM p)
 UNION ALL SELECT url, p_name, 'Could not parse value', CASE WHEN old IS NULL THEN '' ELSE 'n' END, coalesce(old_made, '{NOW}'), '{NOW}', 'microdata', replace(p_name, ' ', ','), 1,
 CASE WHEN p_size / 25.0 >= 0.5 THEN p_brand || '=' || least(4 * p_size, 100) || ',x=50' ELSE 'x=50,' || p_brand || '=' || 4 * p_size END || '|' || p_brand || '=25|' FROM q WHERE p_partkey = twin AND gone = 0""",
    "save_outcome": _BASE + f"SELECT count(*) FILTER (gone = 0 AND old IS NULL AND p_partkey < twin) AS imported, count(*) FILTER (gone = 0 AND NOT (old IS NULL AND p_partkey < twin)) AS updated, count(*) FILTER (gone = 1) AS skipped, (count(*) FILTER (gone = 1))::INT AS errors, 'Item ' || min(p_partkey) FILTER (gone = 1) || ': {_ERROR}' AS first_error FROM q",
    "save_log": _BASE + """, f AS (SELECT unnest([{'f': 'title', 'v': p_name}, {'f': 'servings', 'v': p_brand}, {'f': 'prep_time_minutes', 'v': p_size::VARCHAR}, {'f': 'images', 'v': '["' || p_type || '"]'},
 {'f': 'ingredients', 'v': '[' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: '{"name":"' || w || '","raw_text":"' || w || '"}'), ',') || ']'}, {'f': 'instructions', 'v': '[{"step_number":1,"text":"' || p_type || '"}]'}, {'f': 'tags', 'v': NULL}]) AS x FROM q WHERE gone = 0)
 SELECT x.f AS field_name, 0 AS synced, count(*) AS n, count(*) AS ids, min(x.v) AS least FROM f GROUP BY 1""",
    "update_fields": _BASE + f"""SELECT r.id, CASE WHEN hit AND k % 2 = 0 THEN c_name ELSE title END AS title, CASE WHEN title IS NULL AND NOT (hit AND k % 2 = 0) THEN 'not_found' ELSE 'found' END AS title_status,
 CASE WHEN title IS NULL AND NOT (hit AND k % 2 = 0) THEN 'Not found in source' END AS title_justification, CASE WHEN hit AND k % 3 = 0 THEN k END AS cook_time_minutes, 'found' AS cook_time_status, CASE WHEN hit AND k % 5 = 0 THEN c_mktsegment ELSE 'n' END AS notes,
 CASE WHEN hit THEN '{NOW}' ELSE made END AS updated_at, CASE WHEN hit THEN 'own' ELSE 'first' END AS device_id, CASE WHEN hit AND k % 4 = 0 THEN 1 ELSE coalesce(s.n, 0) END AS steps, CASE WHEN c_custkey IS NOT NULL AND deleted = 1 THEN 'Recipe not found: ' || r.id END AS error
 FROM (SELECT r.*, c_custkey, c_name, c_mktsegment, c_custkey IS NOT NULL AND deleted = 0 AS hit FROM r LEFT JOIN customer ON c_custkey = k) r LEFT JOIN s ON s.id = r.id""",
    "field_round_trip": _BASE + """SELECT id, CASE WHEN title IS NULL THEN '{"status":"not_found","justification":"Not found in source"}' ELSE '{"status":"found","value":"' || title || '"}' END AS title_json, title, CASE WHEN title IS NULL THEN 'not_found' ELSE 'found' END AS title_status, CASE WHEN title IS NULL THEN 'Not found in source' END AS title_justification,
 prep AS prep_time_minutes, CASE WHEN prep IS NULL THEN 'Could not parse value' END AS prep_time_justification, 0::BIGINT AS cook_time_minutes, '["i' || k || '"]' AS images_json, '{"calories":' || k % 900 || '}' AS nutrition_json FROM r WHERE deleted = 0""",
    "tag_round_trip": _BASE + "SELECT id AS recipe_id, domain, label, round(confidence, 6)::DOUBLE AS confidence FROM g",
    "url_validate": f"WITH v(i, normalized, port, error) AS (VALUES {_VALID}) SELECT page_id, normalized, port::INT AS port, error FROM pages JOIN v ON page_id % {len(_URLS)} = i",
    "robots_urls": f"SELECT page_id, lower(regexp_extract(url, {_HOST}, 2)) AS domain, lower(regexp_extract(url, {_HOST}, 1)) || '://' || lower(regexp_extract(url, {_HOST}, 2)) || '/robots.txt' AS robots_url FROM pages",
    "robots_policy": _ROBOTS + """SELECT key, kind <> 'fresh' OR f IN (1, 3) OR (f = 0 AND key % 2 = 1) AS allowed,
 CASE kind WHEN 'cached' THEN 'empty robots.txt — no restrictions' WHEN 'stale' THEN 'empty robots.txt — no restrictions (stale cache)' ELSE CASE f WHEN 0 THEN CASE WHEN key % 2 = 0 THEN 'disallowed by User-agent: *' ELSE 'allowed by robots.txt' END WHEN 1 THEN 'robots.txt not found — allowed per RFC 9309' WHEN 3 THEN 'empty robots.txt — no restrictions' ELSE 'robots.txt unreachable' END END AS reason,
 CASE WHEN kind = 'fresh' AND f = 0 THEN 2.0 END::DOUBLE AS delay, CASE WHEN kind = 'fresh' THEN 'fresh' ELSE 'cached' END AS source FROM d""",
    "robots_refresh": _ROBOTS + f"SELECT domain, CASE WHEN kind = 'cached' THEN 'ok' ELSE CASE f WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found' WHEN 3 THEN 'ok' ELSE 'unreachable' END END AS status, CASE WHEN kind = 'fresh' AND f = 0 THEN {len(_RULES)} ELSE 0 END AS n, CASE WHEN kind = 'cached' THEN 1 ELSE 0 END AS hours FROM d WHERE kind <> 'stale'",
    "cache_times": """WITH d AS (SELECT n_nationkey, DATE '2024-01-01' + 15 * n_nationkey AS a, DATE '2024-01-01' + 15 * n_nationkey + 1 AS b FROM nation),
 x AS (SELECT *, year(a) * 31536000::BIGINT + month(a) * 2592000 + day(a) * 86400 + 21600 AS rough, year(b) * 31536000::BIGINT + month(b) * 2592000 + day(b) * 86400 + 18000 AS later FROM d) SELECT n_nationkey, rough, true AS fresh, later - rough < 86400 AS roughly, true AS kept FROM x""",
    "fetch_errors": f"""WITH x AS ({_FETCHED}) SELECT page_id, kind AS error_type, CASE m WHEN 0 THEN 'Request timed out after 30 seconds' WHEN 1 THEN 'Connection failed' WHEN 2 THEN 'DNS resolution failed' WHEN 3 THEN 'DNS resolution failed' WHEN 4 THEN 'Network error: odd'
 WHEN 5 THEN 'Page not found (404)' WHEN 6 THEN 'HTTP error (418)' WHEN 7 THEN 'Service unavailable (503)' WHEN 8 THEN 'Expected HTML but received text/plain' WHEN 9 THEN 'Response too large: 10485761 bytes (max 10485760 bytes)' WHEN 10 THEN 'Expected HTML but received ' ELSE CASE WHEN kind IS NOT NULL THEN 'Response is not valid UTF-8' END END AS message,
 CASE m WHEN 1 THEN 'refused' WHEN 2 THEN 'DNS failure' WHEN 3 THEN 'no such host x' WHEN 4 THEN 'odd' END AS details, CASE WHEN m = 9 THEN 10485760 END::INT AS max_bytes, CASE WHEN kind IS NULL THEN 200 END::INT AS status_code, kind IS NULL AS moved FROM x""",
    "ingest": URLS_SQL + f""", x AS (SELECT y.*, normalized, path, host, CASE WHEN contains(pages.url, '?') THEN '?' ELSE '' END AS q FROM ({_FETCHED}) y JOIN n USING (page_id) JOIN pages USING (page_id)),
 f AS (SELECT normalized, arg_max({{'k': kind}}, page_id) AS k FROM x GROUP BY 1),
 asked AS (SELECT DISTINCT CASE WHEN page_id % 10 = 0 THEN 'nowhere' ELSE url END AS url, CASE WHEN page_id % 10 > 0 THEN normalized END AS normalized, CASE WHEN page_id % 10 > 0 THEN host END AS host, CASE WHEN page_id % 10 > 0 THEN path END AS path FROM x)
 SELECT CASE WHEN url = 'nowhere' THEN 'validation' WHEN host LIKE '%.org' AND path LIKE '/en%' THEN 'robots_disallowed' ELSE coalesce(f.k.k, 'ok') END AS kind, count(*) AS n, min(url) AS first FROM asked LEFT JOIN f USING (normalized) GROUP BY 1""",
    "sync_cycle": _BASE + f"""SELECT r.id, CASE WHEN NOT gone AND w.title IS NOT NULL THEN w.title.v ELSE r.title END AS title, CASE WHEN (NOT gone AND w.title IS NOT NULL) OR r.title IS NOT NULL THEN 'found' ELSE 'not_found' END AS title_status,
 CASE WHEN NOT gone AND w.description IS NOT NULL THEN w.description.v ELSE r.description END AS description, 'found' AS description_status, CASE WHEN NOT gone AND w.notes IS NOT NULL THEN coalesce(w.notes.v, '') ELSE 'n' END AS notes,
 CASE WHEN NOT gone AND w.servings IS NOT NULL THEN w.servings.v ELSE o_custkey::VARCHAR END AS servings, CASE WHEN gone THEN 1 WHEN gone_at IS NOT NULL THEN 0 ELSE deleted END AS deleted,
 CASE WHEN NOT gone AND (w.title IS NOT NULL OR w.description IS NOT NULL OR w.notes IS NOT NULL OR w.servings IS NOT NULL) THEN '{NOW}' ELSE r.made END AS updated_at FROM r JOIN orders ON o_orderkey = k LEFT JOIN w ON w.id = r.id""",
    "sync_counts": _BASE + f""", c AS (SELECT (SELECT count(*) FROM l WHERE device = 'own') AS exported, (SELECT count(*) FROM l WHERE device <> 'own') AS imported, (SELECT count(*) FROM w JOIN r USING (id)) AS merged,
 (SELECT string_agg(device || ':' || last || ':{NOW}', ',' ORDER BY device) FROM (SELECT device, max(event_id) AS last FROM l WHERE device <> 'own' GROUP BY 1)) AS marks)
 SELECT exported, imported, merged, 1 AS turn, marks FROM c UNION ALL SELECT 0, 0, merged, 2, marks FROM c""",
    "file_import": _BASE + """SELECT source_url, title, CASE WHEN title IS NULL THEN 'Not found in import' END AS title_why, prep, k % 900 AS calories, coalesce(i.n, 0)::INT AS n_ingredients, coalesce(i.names, '') AS ingredients, coalesce(t.tags, '||') AS tags FROM r LEFT JOIN i USING (id) LEFT JOIN t USING (id) WHERE k % 40 = 1""",
    "times": "SELECT p_partkey, strftime(DATE '1970-01-01' + p_size, '%Y-%m-%d') || 'T00:00:00.250000Z' AS at, strftime(DATE '1970-01-01' + p_size, '%Y-%m-%d') AS day, least(p_size / 25, 1)::DOUBLE AS clamped, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE least(p_size / (p_partkey % 3 * 10), 1) END::DOUBLE AS score, CASE WHEN p_partkey % 2 = 1 THEN p_size END::BIGINT AS count, (p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS amount FROM part",
    "tag_sets": _sets_sql("c"),
    "refine": _sets_sql("c2"),
    "ingredient_normal": "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'skinless ' || lower(p_name) WHEN 3 THEN 'fresh ' || lower(p_name) ELSE 'milk' END AS name FROM part",
}
