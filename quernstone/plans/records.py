"""Queries of records, labels, crawl rules and stores, with their SQL oracles.

The driver's pages hold no recipe markup, so `part` is written as pages that do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import durations
from quernstone.operators import robots, store, tagging
from quernstone.plans import stores
from quernstone.sources import interchange, records
from quernstone.streaming import sync

#: Small vocabularies for the driver's tables: label, title, ingredient and step words.
CUISINES = [("widget", ["widget"], ["cold", "widget"], ["econ"]), ("small", ["small"], ["small", "widget"], ["standard"]), ("gear", ["gear"], ["gear", "hot"], [])]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def marked_pages(spark, d):
    """page_id and html: JSON-LD, microdata or no markup by the key's remainder by 3."""
    value = F.struct(F.lit("Recipe").alias("@type"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("recipeIngredient"), F.concat(F.lit("PT"), "p_size", F.lit("M")).alias("prepTime"), F.col("p_type").alias("recipeInstructions"))
    script = F.concat(F.lit('<html><script type="application/ld+json">'), F.to_json(value), F.lit("</script></html>"))
    items = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit('<li itemprop="recipeIngredient">'), w, F.lit("</li>"))), "")
    scope = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Recipe"><h1 itemprop="name">'), "p_name", F.lit('</h1><meta itemprop="prepTime" content="PT'), "p_size", F.lit('M"><ul>'), items, F.lit('</ul><p itemprop="recipeInstructions">'), "p_type", F.lit("</p></div>"))
    kind = F.col("p_partkey") % 3
    return _table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.when(kind == 0, script).when(kind == 1, scope).otherwise("<p>no recipe</p>").alias("html"))


def _parts(spark, d):
    return _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("description"), F.split("p_name", " ").alias("ingredients"), F.array("p_type").alias("instructions"))


def record_extract(spark, d):
    r = records.extracted(marked_pages(spark, d))
    return r.select("id", "source", F.col("title.value").alias("title"), F.size(F.coalesce("ingredients", F.array().cast("array<string>"))).alias("n_ingredients"), F.col("prep_time_minutes.value").alias("prep"), F.try_element_at("instructions", F.lit(1))["text"].alias("step"), "error_type")


def extract_negative(spark, d):
    return records.extracted(_table(spark, d, "pages")).select(F.col("id").alias("page_id"), "error_type", "html_preview")


def cuisine_tags(spark, d):
    return tagging.cuisines(_parts(spark, d), CUISINES).select("id", "label", F.round("confidence", 6).alias("confidence"))


def course_tags(spark, d):
    return tagging.courses(_parts(spark, d), CUISINES).select("id", "label", F.round("confidence", 6).alias("confidence"))


def diet_tags(spark, d):
    """Diets of orders whose lines' return flags play ingredients."""
    rows = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_returnflag").alias("ingredients"))
    return tagging.diets(rows, {"a": "milk"}, {"milk": ["ContainsDairy"], "r": ["ContainsMeat", "HighFat"]}).select("id", "label", F.round("confidence", 6).alias("confidence"))


def label_counts(spark, d):
    """How many stored pages carry each label: pages to records to labels."""
    r = records.extracted(marked_pages(spark, d)).where("error_type is null")
    rows = r.select("id", F.col("title.value").alias("title"), F.col("description.value").alias("description"), "ingredients", F.transform("instructions", lambda s: s["text"]).alias("instructions"))
    return tagging.cuisines(rows, CUISINES).groupBy("label").agg(F.count(F.lit(1)).alias("pages"))


def durations_all(spark, d):
    n, text = F.col("p_size"), F.concat(F.lit("PT"), F.col("p_size") % 5, F.lit("H"), F.col("p_size"), F.lit("M"))
    words = F.concat(n.cast("string"), F.lit(" minutes"))
    return _table(spark, d, "part").select("p_partkey", durations.iso_minutes(text).alias("iso"), durations.flexible_minutes(words).alias("flexible"), durations.import_minutes(text).alias("imported"), durations.export_minutes(n).alias("exported"))


def robots_decision(spark, d):
    host = F.col("n_nationkey")
    text = F.concat(F.lit("User-agent: *\nDisallow: /private\nCrawl-delay: "), host, F.lit("\nUser-agent: RecipeScraper\nAllow: /private/open\nDisallow: /private"))
    status = F.element_at(F.array(*map(F.lit, ("ok", "not_found", "unreachable", "oversized"))), (host % 4 + 1).cast("int"))
    path = F.when(host % 8 == 0, "/private/open/a").otherwise("/private/b")
    df = _table(spark, d, "nation").select("n_nationkey", status.alias("status"), text.alias("text"), path.alias("path"), (host % 3 == 0).alias("stale"))
    return robots.decided(df).select("n_nationkey", "allowed", "reason", robots.crawl_delay(F.col("text")).alias("delay"))


def robots_cache_latest(spark, d):
    log = _table(spark, d, "events").groupBy(F.col("user_id").alias("domain"), F.col("ts").alias("fetched_at")).agg(F.max("props").alias("text"), F.max("event_type").alias("status"))
    return robots.pruned(robots.cache_latest(log), F.lit("2024-02-01").cast("timestamp_ntz"), 7).select("domain", "text", "status")


def fetch_accept(spark, d):
    code = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(200), F.lit(200)), (F.col("page_id") % 4 + 1).cast("int"))
    kind = F.when(F.col("page_id") % 4 == 2, "text/plain").otherwise("text/html; charset=utf-8")
    return _table(spark, d, "pages").select("page_id", robots.fetch_error(code, kind, F.octet_length("html")).alias("error"))


def change_log_unpivot(spark, d):
    base = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("notes"))
    return sync.unpivoted(base, ["title", "notes"], F.lit("t"), F.lit("d")).select("record", "field", "value")


def _changes(events):
    """Events as changes; a third of them are of the own device."""
    field = F.when(F.col("event_type") == "error", "notes").otherwise(F.col("event_type"))
    return events.select(F.col("user_id").alias("record"), field.alias("field"), F.when(F.col("event_id") % 4 > 0, F.col("value").cast("string")).alias("value"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("device"))


def _customers(spark, d):
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1.0).alias("click"), F.lit("n").alias("notes"), F.lit(0).alias("deleted"), F.lit("old").alias("updated_at"))


def _streamed(spark, d):
    """The events as a stream, in a session of its own, whose settings stay out of the caller's."""
    side = spark.newSession()
    side.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return side.readStream.schema(_table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


def lww_merge(spark, d):
    """Records after the merge of events as changes."""
    return sync.merged(_customers(spark, d), _changes(_table(spark, d, "events")), F.lit("new"), 0, ("click", "notes"), "signup")


def stream_merge(spark, d):
    """`lww_merge` over the events as a stream."""
    return sync.merged_stream(_customers(spark, d), _changes(_streamed(spark, d)), stores.shared(spark, "stream"), F.lit("new"), 0, ("click", "notes"), "signup")


def stream_lww(spark, d):
    """`lww_latest` over the events as a stream."""
    log = _streamed(spark, d).select(F.col("user_id").alias("record"), F.col("event_type").alias("field"), "value", F.col("ts").alias("at"), F.col("event_id").alias("device"))
    return sync.latest_stream(log, stores.shared(spark, "stream")).select("record", "field", "value")


def variant_pages(spark, d):
    """page_id and html: by the key's remainder by 6 a graph, sections, numbers, odd images, microdata with nutrition, an empty recipe."""
    name, kind, size, key = F.col("p_name"), F.col("p_type"), F.col("p_size"), F.col("p_partkey")
    script = lambda *xs: F.concat(F.lit("<p>x</p><script type='application/ld+json'>{bad</script><script type='application/ld+json'>"), *(F.lit(x) if isinstance(x, str) else x for x in xs), F.lit("</script>"))
    graph = script('{"@graph": [{"@type": "WebSite", "name": "w"}, {"@type": ["Thing", "http://schema.org/Recipe"], "name": ["", "', name, '"], "prepTime": "PT1H', size, 'M", "recipeYield": [', size, ', "x"], "image": ["a", {"url": "b"}, {"contentUrl": "c"}, 5]}]}')
    sections = script('[[{"@type": "\\u0052ecipe", "name": "', name, '", "cookTime": ', size, ', "yield": "six", "recipeInstructions": [{"@type": "HowToSection", "name": "', kind, '", "itemListElement": [{"@type": "HowToStep", "text": " s1 "}, {"name": "s2"}, "no"]}, " s3 ", {"text": ""}], "image": {"url": "", "contentUrl": "b"}}]]')
    numbers = script('{"@type": "Recipe", "recipeIngredient": ["1 ', name, '", " ", 7], "nutrition": {"calories": ', size, '.9, "fatContent": -5, "sodiumContent": 1e21, "fiberContent": 1e-7, "sugarContent": "', size, '.5 g", "proteinContent": " 3 g", "carbohydrateContent": "1.2.3"}, "prepTime": "1 hour 30 minutes", "cookTime": -5}')
    lines = script('{"@type": "Recipe", "name": 5, "nutrition": null, "recipeInstructions": "one\\n\\n', kind, '", "image": " i "}')
    item = F.concat(F.lit('<div itemscope itemtype="http://schema.org/Recipe"><h1 itemprop="name"> '), name, F.lit('</h1><img itemprop="image" src="s.png"><a itemprop="image" href="h"></a><span itemprop="calories">999</span><div itemprop="nutrition" itemscope><i itemprop="calories">'), size, F.lit(' kcal</i><i itemprop="fatContent">.5 g</i></div><div itemprop="recipeInstructions" itemscope><b itemprop="name">mix</b></div><p itemprop="recipeInstructions">a\n\nb</p></div>'))
    empty = script('{"@type": "Recipe", "image": "x"}')
    html = F.element_at(F.array(graph, sections, numbers, lines, item, empty), (key % 6 + 1).cast("int"))
    return _table(spark, d, "part").select(key.alias("page_id"), html.alias("html"))


def extract_variants(spark, d):
    """Every field of the records of `variant_pages`, with why a page has none."""
    r = records.extracted(variant_pages(spark, d))
    n = F.col("nutrition.value")
    steps = F.array_join(F.transform("instructions", lambda s: F.concat(s["step_number"], F.lit("."), s["text"])), "|")
    return r.select(
        "id", "source", F.col("title.value").alias("title"), F.array_join("ingredients", "|").alias("ingredients"), steps.alias("steps"), F.col("prep_time_minutes.value").alias("prep"), F.col("cook_time_minutes.justification").alias("cook_why"), F.col("servings.value").alias("servings"), F.array_join("images.value", "|").alias("images"),
        n["calories"].alias("calories"), n["fat_grams"].alias("fat"), n["sodium_mg"].alias("sodium"), n["fiber_grams"].alias("fiber"), n["sugar_grams"].alias("sugar"), n["protein_grams"].alias("protein"), n["carbs_grams"].alias("carbs"), F.col("nutrition.justification").alias("nutrition_why"), "error_type", "json_ld_error", "microdata_error",
    )


def extract_and_tag(spark, d):
    """Pages to records to tags, in one pass."""
    done = tagging.tagged_pages(records.extracted(marked_pages(spark, d)), tagging.Vocabulary(CUISINES))
    return done.select("id", F.array_join(F.transform("tags.cuisine", lambda t: t["label"]), ",").alias("cuisines"), F.size("tags.diet").alias("diets"))


def _extras(title, number, brand):
    """The further properties of a record, of its other values."""
    tag = lambda label: F.array(F.struct(label.alias("label"), (number / 64).alias("confidence")))
    counts = ("calories", "sodium_mg")
    return {
        "nutrition": F.struct(*(number.cast("bigint").alias(n) if n in counts else (number / 4 + i).alias(n) for i, (n, *_) in enumerate(interchange.NUTRITION))),
        "source": F.element_at(F.array(*map(F.lit, ("json_ld", "microdata", "ai_fallback"))), number % 3 + 1),
        "tags": F.struct(tag(title).alias("cuisine"), tag(brand).alias("course"), F.slice(tag(brand), 1, number % 2).alias("diet")),
        "notes": F.concat(F.lit("of "), brand),
        "ingredients_parsed": F.transform(F.split(title, " "), lambda w: F.struct(F.upper(w).alias("name"), (number / 2).alias("quantity"), F.when(number % 2 == 0, brand).alias("unit"), w.alias("raw_text"))),
    }


def interchange_round_trip(spark, d):
    """Records out as schema.org JSON and in again; `error` also names properties that came back changed."""
    none = F.lit(None).cast("string")
    steps = F.array(F.struct(F.lit(1).alias("step_number"), F.col("p_type").alias("text")))
    rows = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), none.alias("description"), F.split("p_name", " ").alias("ingredients"), steps.alias("instructions"), F.col("p_size").alias("prep"), F.lit(None).cast("int").alias("cook"), F.col("p_brand").alias("servings"), F.concat(F.lit("http://x/"), "p_partkey").alias("url"), F.array().cast("array<string>").alias("images"), *(c.alias(n) for n, c in _extras(F.col("p_name"), F.col("p_size").cast("int"), F.col("p_brand")).items()))
    back = interchange.imported(interchange.exported(rows))
    changed = F.concat_ws(", ", *(F.when(~F.col(n).eqNullSafe(c), f"changed {n}") for n, c in _extras(F.col("title"), F.col("prep").cast("int"), F.col("servings")).items()))
    return back.select("url", "title", "description", F.array_join("ingredients", " ").alias("ingredients"), F.get("instructions", F.lit(0))["text"].alias("step"), "prep", "cook", "servings", F.coalesce("error", F.nullif(changed, F.lit(""))).alias("error"))


QUERIES: dict = {f.__name__: f for f in (record_extract, extract_negative, cuisine_tags, course_tags, diet_tags, label_counts, durations_all, robots_decision, robots_cache_latest, fetch_accept, change_log_unpivot, lww_merge, stream_merge, stream_lww, extract_variants, extract_and_tag, interchange_round_trip)}

_VOC = ", ".join(f"('{n}', {t}, {p}, {s}::VARCHAR[])" for n, t, p, s in CUISINES)
_SIGNALS = f"""
WITH v(label, t, p, s) AS (VALUES {_VOC}),
x AS (SELECT p_partkey AS id, label, lower(p_name) AS name, lower(p_type) AS kind, t, p, s FROM part, v),
n AS (SELECT id, label, len(list_filter(t, lambda w: contains(name, w))) > 0 AS title, least(len(list_filter(p, lambda w: contains(name, w))) / 2.0, 1) AS parts,
 least(len(list_filter(s, lambda w: contains(kind, w))), 1) AS steps, least(len(list_filter(s, lambda w: contains(name || '  ' || kind, w))), 1) AS context FROM x),
cuisine AS (SELECT id, label, round(0.35 * title::INT + 0.35 * parts + 0.30 * steps, 6)::DOUBLE AS confidence FROM n),
course AS (SELECT id, label, round(0.40 * title::INT + 0.25 * parts + 0.15 * context, 6)::DOUBLE AS confidence FROM n)
"""
_DIETS = ", ".join(f"('{n}', {x})" for n, x in tagging.DIETS)
ORACLE: dict = {
    "record_extract": "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'microdata' END AS source, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS title, CASE WHEN p_partkey % 3 < 2 THEN len(string_split(p_name, ' ')) ELSE 0 END::INT AS n_ingredients, CASE WHEN p_partkey % 3 < 2 THEN p_size::BIGINT END AS prep, CASE WHEN p_partkey % 3 < 2 THEN p_type END AS step, CASE WHEN p_partkey % 3 = 2 THEN 'no_recipe_found' END AS error_type FROM part",
    "extract_negative": "SELECT page_id, 'no_recipe_found' AS error_type, CASE WHEN strlen(html) > 200 THEN substring(html, 1, 200) || '...' ELSE html END AS html_preview FROM pages",
    "cuisine_tags": _SIGNALS + "SELECT * FROM cuisine WHERE confidence >= 0.5",
    "course_tags": _SIGNALS + "SELECT * FROM course WHERE confidence >= 0.5",
    "label_counts": _SIGNALS + "SELECT label, count(*) AS pages FROM cuisine WHERE confidence >= 0.5 AND id % 3 < 2 GROUP BY 1",
    "diet_tags": f"WITH v(label, outs) AS (VALUES {_DIETS}), o AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS u FROM lineitem GROUP BY 1) SELECT id, label, round(1 - 0.2 * u, 6)::DOUBLE AS confidence FROM o, v WHERE u <= 2 AND NOT (a AND list_contains(outs, 'ContainsDairy')) AND NOT (r AND list_has_any(outs, ['ContainsMeat', 'HighFat']))",
    "durations_all": "SELECT p_partkey, (p_size % 5 * 60 + p_size)::BIGINT AS iso, p_size::BIGINT AS flexible, (p_size % 5 * 60 + p_size)::BIGINT AS imported, 'PT' || p_size || 'M' AS exported FROM part",
    "robots_decision": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_nationkey % 8 = 0 WHEN 2 THEN false ELSE true END AS allowed, CASE n_nationkey % 4 WHEN 0 THEN CASE WHEN n_nationkey % 8 = 0 THEN 'allowed by robots.txt' ELSE 'disallowed by User-agent: *' END WHEN 1 THEN 'robots.txt not found — allowed per RFC 9309' WHEN 2 THEN 'robots.txt unreachable' ELSE 'robots.txt oversized — treated as empty per policy' END || CASE WHEN n_nationkey % 3 = 0 THEN ' (stale cache)' ELSE '' END AS reason, n_nationkey::DOUBLE AS delay FROM nation",
    "robots_cache_latest": "WITH l AS (SELECT user_id AS domain, ts, max(props) AS text, max(event_type) AS status FROM events GROUP BY 1, 2) SELECT domain, arg_max(text, ts) AS text, arg_max(status, ts) AS status FROM l GROUP BY 1 HAVING epoch(TIMESTAMP '2024-02-01') - epoch(date_trunc('second', max(ts))) <= 7 * 86400",
    "fetch_accept": "SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'http' WHEN page_id % 4 = 2 THEN 'content_type' WHEN strlen(html) > 10485760 THEN 'size' END AS error FROM pages",
    "change_log_unpivot": "SELECT c_custkey AS record, 'title' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'notes', c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE'",
    "lww_merge": """WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'notes' ELSE event_type END AS field, CASE WHEN event_id % 4 > 0 THEN value END AS v, ts, event_id % 3 AS device FROM events),
l AS (SELECT user_id, field, arg_max({'v': v}, (ts, device)) AS s, max(ts) AS t FROM e WHERE user_id IN (SELECT user_id FROM e WHERE device <> 0) GROUP BY 1, 2),
w AS (SELECT user_id, any_value(s) FILTER (field = 'click') AS c, any_value(s) FILTER (field = 'notes') AS n, bool_or(field = 'signup') AS named,
 bool_or(field = 'signup') AND coalesce(max(t) FILTER (field <> 'signup') <= max(t) FILTER (field = 'signup'), true) AS gone FROM l GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN NOT gone AND c IS NOT NULL THEN c.v ELSE -1.0 END::DOUBLE AS click, CASE WHEN NOT gone AND n IS NOT NULL THEN coalesce(n.v::VARCHAR, '') ELSE 'n' END AS notes,
 coalesce(gone, false)::INT AS deleted, CASE WHEN NOT coalesce(gone, true) AND (c IS NOT NULL OR n IS NOT NULL) THEN 'new' ELSE 'old' END AS updated_at, user_id IS NOT NULL AS merged FROM customer LEFT JOIN w ON user_id = c_custkey""",
    "extract_variants": """WITH p AS (SELECT *, p_partkey % 6 AS m FROM part) SELECT p_partkey AS id, CASE WHEN m < 4 THEN 'json_ld' WHEN m = 4 THEN 'microdata' END AS source, CASE WHEN m IN (0, 1, 4) THEN p_name END AS title, CASE WHEN m = 2 THEN '1 ' || p_name WHEN m < 5 THEN '' END AS ingredients,
 CASE m WHEN 0 THEN '' WHEN 1 THEN '1.' || p_type || '|2.s1|3.s2|4.s3' WHEN 2 THEN '' WHEN 3 THEN '1.one|3.' || p_type WHEN 4 THEN '1.mix|2.a|3.b' END AS steps, CASE m WHEN 0 THEN 60 + p_size WHEN 2 THEN 7800 END::BIGINT AS prep,
 CASE m WHEN 1 THEN NULL WHEN 2 THEN 'Could not parse value' ELSE 'Not found in source' END AS cook_why, CASE m WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'six' END AS servings, CASE m WHEN 0 THEN 'a|b|c' WHEN 3 THEN 'i' WHEN 4 THEN 's.png|h' END AS images,
 CASE WHEN m IN (2, 4) THEN p_size END::BIGINT AS calories, CASE m WHEN 2 THEN -5 WHEN 4 THEN 0.5 END::DOUBLE AS fat, CASE WHEN m = 2 THEN 4294967295 END::BIGINT AS sodium, CASE WHEN m = 2 THEN 1e-7 END::DOUBLE AS fiber, CASE WHEN m = 2 THEN p_size + 0.5 END::DOUBLE AS sugar, NULL::DOUBLE AS protein, NULL::DOUBLE AS carbs,
 CASE WHEN m = 3 THEN 'Could not parse value' WHEN m NOT IN (2, 4) THEN 'Not provided' END AS nutrition_why, CASE WHEN m = 5 THEN 'no_recipe_found' END AS error_type, CASE m WHEN 4 THEN 'No JSON-LD scripts found' WHEN 5 THEN 'Recipe schema found but no content could be extracted' END AS json_ld_error, CASE WHEN m = 5 THEN 'No Recipe microdata itemscope found' END AS microdata_error FROM p""",
    "extract_and_tag": _SIGNALS + "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN coalesce(c, '') END AS cuisines, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN len(string_split(p_name, ' ')) <= 2 THEN 15 ELSE 0 END::INT AS diets FROM part LEFT JOIN (SELECT cuisine.id, string_agg(label, ',' ORDER BY confidence DESC, list_position(['widget', 'small', 'gear'], label)) AS c FROM cuisine WHERE confidence >= 0.5 GROUP BY 1) x ON x.id = p_partkey",
    "interchange_round_trip": "SELECT 'http://x/' || p_partkey AS url, p_name AS title, NULL AS description, p_name AS ingredients, p_type AS step, p_size AS prep, NULL AS cook, p_brand AS servings, NULL AS error FROM part",
    "stream_lww": "SELECT user_id AS record, event_type AS field, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
}
ORACLE["stream_merge"] = ORACLE["lww_merge"]
