"""The record store as tables: save, update, delete, read, search.

A store is five tables. `recipes` is flat: every field has its value, status and
justification; images and nutrition are JSON text. `ingredients`, `instructions` and
`tags` are its children, `change_log` what happened. Writers take a store and give the
next one and a table of results; nothing is changed in place, so a snapshot of each is
written as any table is. Times are text that sorts as time does.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators import fields

INGREDIENT = "struct<name:string,quantity:double,unit:string,raw_text:string>"
INSTRUCTION = "struct<step_number:int,text:string>"
TAG = "struct<label:string,confidence:double>"
NUTRITION = "struct<calories:bigint,fat_grams:double,saturated_fat_grams:double,carbs_grams:double,fiber_grams:double,sugar_grams:double,protein_grams:double,sodium_mg:bigint>"
DOMAINS = ("cuisine", "course", "diet")
#: Fields of a record: name, prefix of its status columns, type.
FIELDS = [
    ("title", "title", "string"),
    ("description", "description", "string"),
    ("servings", "servings", "string"),
    ("prep_time_minutes", "prep_time", "bigint"),
    ("cook_time_minutes", "cook_time", "bigint"),
    ("images", "images", "array<string>"),
    ("nutrition", "nutrition", NUTRITION),
]
LOGGED = ("title", "description", "servings", "prep_time_minutes", "cook_time_minutes", "images", "nutrition", "ingredients", "instructions", "tags")
PATCHED = ("title", "description", "servings", "prep_time_minutes", "cook_time_minutes", "notes", "ingredients", "instructions", "tags")
DELETION = "__deleted"

RECIPES = (
    "id string, source_url string, "
    + ", ".join(f"{n}{'_json string' if t.startswith(('array', 'struct')) else ' ' + t}, {p}_status string, {p}_justification string" for n, p, t in FIELDS)
    + ", extraction_source string, notes string, created_at string, updated_at string, deleted int, device_id string"
)
INGREDIENTS = "recipe_id string, position int, name string, quantity double, unit string, raw_text string"
INSTRUCTIONS = "recipe_id string, step_number int, text string"
TAGS = "recipe_id string, domain string, label string, confidence double"
CHANGE_LOG = "id bigint, recipe_id string, field_name string, field_value string, modified_at string, device_id string, synced int"


@dataclass(frozen=True)
class Store:
    recipes: DataFrame
    ingredients: DataFrame
    instructions: DataFrame
    tags: DataFrame
    change_log: DataFrame


def _nested(kind: str) -> bool:
    return kind.startswith(("array", "struct"))


def flat_fields(column) -> list[Column]:
    """The flat columns of all fields; `column` gives the struct of a name."""
    return [c.alias(n) for name, prefix, kind in FIELDS for n, c in fields.to_columns(column(name), name, prefix, _nested(kind)).items()]


def struct_fields() -> list[Column]:
    """The structs of all fields, from the flat columns."""
    out = []
    for name, prefix, kind in FIELDS:
        value = F.from_json(f"{name}_json", kind) if _nested(kind) else F.col(name)
        empty = F.from_json(F.lit("[]" if kind.startswith("array") else "{}"), kind) if _nested(kind) else F.lit("" if kind == "string" else 0).cast(kind)
        out.append(fields.from_columns(F.col(f"{prefix}_status"), value, F.col(f"{prefix}_justification"), empty).alias(name))
    return out


def tag_rows(sets: DataFrame, id_col: str = "id", tags_col: str = "tags") -> DataFrame:
    """recipe_id, domain, label, confidence, position of every tag of the three lists, one after the other."""

    def listed(domain: str) -> Column:
        tags = F.coalesce(F.col(f"{tags_col}.{domain}"), F.array().cast(f"array<{TAG}>"))
        return F.transform(tags, lambda t: F.struct(F.lit(domain).alias("domain"), t["label"].alias("label"), fields.clamped(t["confidence"]).alias("confidence")))

    lists = [listed(d) for d in DOMAINS]
    return sets.select(F.col(id_col).alias("recipe_id"), F.posexplode(F.concat(*lists)).alias("position", "t")).select("recipe_id", "t.domain", "t.label", "t.confidence", "position")


def tag_sets(tags: DataFrame) -> DataFrame:
    """recipe_id and tags: the three lists, surest first, ties by label; other domains are left out."""

    def listed(domain: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("domain") == domain, F.struct((-F.col("confidence")).alias("k"), "label", "confidence"))))
        return F.transform(rows, lambda x: F.struct(x["label"].alias("label"), fields.clamped(x["confidence"]).alias("confidence"))).alias(domain)

    return tags.groupBy("recipe_id").agg(F.struct(*(listed(d) for d in DOMAINS)).alias("tags"))


def _with_tags(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """`rows` (id, ...) with their tag sets, empty ones where there are no tags."""
    empty = F.struct(*(F.array().cast(f"array<{TAG}>").alias(d) for d in DOMAINS))
    sets = tag_sets(tags).withColumnRenamed("recipe_id", "t_id")
    return rows.join(sets, F.col("id") == F.col("t_id"), "left").drop("t_id").withColumn("tags", F.coalesce("tags", empty))


def active(recipes: DataFrame) -> DataFrame:
    return recipes.where("deleted = 0")


def summaries(recipes: DataFrame, tags: DataFrame) -> DataFrame:
    """Eight columns and the tag set of the given records."""
    return _with_tags(recipes.select("id", "source_url", "title", "description", "prep_time_minutes", "cook_time_minutes", "created_at", "updated_at"), tags)


def newest_first(rows: DataFrame) -> DataFrame:
    """By the last update, the newest first, ties by id."""
    return rows.orderBy(F.col("updated_at").desc(), "id")


def listed(store: Store) -> DataFrame:
    """Summaries of all active records, newest first."""
    return newest_first(summaries(active(store.recipes), store.tags))


def assembled(store: Store, recipes: DataFrame | None = None) -> DataFrame:
    """Whole records: field structs, ingredients and instructions in order, tags, notes and times."""
    recipes = active(store.recipes) if recipes is None else recipes

    def children(table: DataFrame, order: str, kind: str, name: str) -> DataFrame:
        names = [x.split(":")[0] for x in kind.removeprefix("struct<").removesuffix(">").split(",")]
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.struct(*names).alias("v"))))
        return table.groupBy(F.col("recipe_id").alias("id")).agg(F.transform(rows, lambda x: x["v"]).cast(f"array<{kind}>").alias(name))

    whole = recipes.select("id", "source_url", *struct_fields(), F.col("extraction_source").alias("source"), "notes", "created_at", "updated_at")
    for table, order, kind, name in ((store.ingredients, "position", INGREDIENT, "ingredients"), (store.instructions, "step_number", INSTRUCTION, "instructions")):
        whole = whole.join(children(table, order, kind, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return _with_tags(whole, store.tags)


def looked_up(store: Store, ids: DataFrame) -> DataFrame:
    """The whole record of every asked `id`, or an error where none is active."""
    asked = ids.select("id").distinct()
    wanted = active(store.recipes).join(asked, "id", "left_semi")
    of_wanted = lambda table: table.join(asked, table["recipe_id"] == asked["id"], "left_semi")
    few = replace(store, ingredients=of_wanted(store.ingredients), instructions=of_wanted(store.instructions), tags=of_wanted(store.tags))
    found = assembled(few, wanted)
    return asked.join(found, "id", "left").withColumn("error", F.when(F.col("updated_at").isNull(), F.concat(F.lit("Recipe not found: "), "id")))


def like_pattern(text: str) -> str:
    """A regular expression for texts that hold `text`: A to Z in any case, % any run, _ any character."""
    quoted = "".join({"%": ".*", "_": "."}.get(c, c if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}") for c in text)
    return f"(?is){quoted}"


def holding_text(recipes: DataFrame, ingredients: DataFrame, text: str) -> DataFrame:
    """Records whose title, or one of whose ingredients' names, holds `text`; all where it is empty."""
    if text == "":
        return recipes
    pattern = like_pattern(text)
    hits = ingredients.where(F.col("name").rlike(pattern)).select(F.col("recipe_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return recipes.join(hits, "id", "left").where(F.coalesce(F.col("title").rlike(pattern), F.lit(False)) | F.coalesce("hit", F.lit(False))).drop("hit")


def having_tags(recipes: DataFrame, tags: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Records that carry every wanted label in its domain, exactly as spelled; all where none is wanted."""
    pairs = sorted({(d, label) for d, labels in wanted.items() for label in labels})
    if not pairs:
        return recipes
    pair = F.struct("domain", "label")
    met = tags.where(pair.isin([F.struct(F.lit(d).alias("domain"), F.lit(x).alias("label")) for d, x in pairs]))
    full = met.groupBy(F.col("recipe_id").alias("id")).agg(F.count_distinct("domain", "label").alias("n")).where(F.col("n") == len(pairs))
    return recipes.join(full.select("id"), "id", "left_semi")


def search(store: Store, text: str | None = None, **wanted: list[str]) -> DataFrame:
    """Summaries of active records by text and by labels of cuisine, course and diet, newest first."""
    rows = holding_text(active(store.recipes), store.ingredients, text or "")
    return newest_first(summaries(having_tags(rows, store.tags, wanted), store.tags))


def _logged(rows: DataFrame, names: tuple[str, ...], now: Column, device: str) -> DataFrame:
    """recipe_id, field_name, field_value, ... of every text column of `rows` (id, seq, names) that is not null."""
    pairs = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("field_name"), F.col(n).alias("field_value")) for i, n in enumerate(names)))
    one = rows.select("id", "seq", F.explode(F.filter(pairs, lambda p: p["field_value"].isNotNull())).alias("p"))
    return one.select(F.col("id").alias("recipe_id"), "p.field_name", "p.field_value", now.cast("string").alias("modified_at"), F.lit(device).alias("device_id"), F.lit(0).alias("synced"), "seq", "p.at")


def appended(log: DataFrame, rows: DataFrame) -> DataFrame:
    """`log` and new rows, whose ids go on from the log's highest, in the rows' order.

    Rows are ranked within ranges of their order, and the ranges counted up: no task
    ranks them all.
    """
    order = [c for c in ("seq", "recipe_id", "at") if c in rows.columns]
    last = log.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = rows.orderBy(*order).withColumn("id", last + 1 + F.monotonically_increasing_id())
    return log.unionByName(new.select(*(F.col(c).cast(log.schema[c].dataType).alias(c) for c in log.columns)))


def saved(store: Store, saves: DataFrame, now: Column, device: str) -> tuple[Store, DataFrame]:
    """The store after `saves`, and source_url, seq, id, created, error of each.

    A save has source_url, seq (its order), the field structs, source, ingredients,
    instructions and tags. It replaces the active record of its URL but for id, notes and
    time of creation, or makes a new one; of several saves of a URL the last stays and the
    first may create. A URL whose record is deleted is an error. New ids come from the URL,
    so a rerun gives the same. Each save is logged.
    """
    taken = store.recipes.select(F.col("source_url").alias("u"), F.col("id").alias("old"), F.col("deleted").alias("gone"))
    first = saves.groupBy("source_url").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    rows = saves.join(first, "source_url").join(taken, F.col("source_url") == F.col("u"), "left").drop("u")
    rows = rows.withColumns(
        {
            "id": F.coalesce("old", F.sha2("source_url", 256)),
            "created": F.col("old").isNull() & (F.col("seq") == F.col("first")),
            "error": F.when(F.col("gone") != 0, "Failed to insert recipe: UNIQUE constraint failed: recipes.source_url"),
        }
    )
    results = rows.select("source_url", "seq", F.when(F.col("error").isNull(), F.col("id")).alias("id"), F.when(F.col("error").isNull(), F.col("created")).alias("created"), "error")
    good = rows.where("error is null")
    final = good.where("seq = last")

    kept = store.recipes.select("id", F.col("notes").alias("old_notes"), F.col("created_at").alias("old_created"))
    flat = final.join(kept, "id", "left").select(
        "id",
        "source_url",
        *flat_fields(F.col),
        F.coalesce("source", F.lit("json_ld")).alias("extraction_source"),
        F.coalesce("old_notes", F.lit("")).alias("notes"),
        F.coalesce("old_created", now.cast("string")).alias("created_at"),
        now.cast("string").alias("updated_at"),
        F.lit(0).alias("deleted"),
        F.lit(device).alias("device_id"),
    )
    recipes = store.recipes.join(final.select("id"), "id", "left_anti").unionByName(flat.select(*(F.col(c).cast(store.recipes.schema[c].dataType).alias(c) for c in store.recipes.columns)))
    out = _replaced(replace(store, recipes=recipes), final, ("ingredients", "instructions", "tags"))

    text = lambda n, kind: F.when(F.col(f"{n}.status") == "found", F.to_json(F.col(f"{n}.value")) if _nested(kind) else F.col(f"{n}.value").cast("string")).alias(n)
    values = good.select("id", "seq", *(text(n, kind) for n, _, kind in FIELDS), *(F.to_json(c).alias(c) for c in ("ingredients", "instructions", "tags")))
    return replace(out, change_log=appended(store.change_log, _logged(values, LOGGED, now, device))), results


def _replaced(store: Store, rows: DataFrame, names: tuple[str, ...]) -> Store:
    """The store whose named children of `rows` (id, ingredients, instructions, tags) are those of the rows; null lists change nothing.

    Ingredients are numbered from 0. Of tags with one domain and label the last stays.
    """

    def swap(table: DataFrame, name: str, new: DataFrame) -> DataFrame:
        owners = rows.where(F.col(name).isNotNull()).select(F.col("id").alias("recipe_id"))
        return table.join(owners, "recipe_id", "left_anti").unionByName(new.select(*(F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns)))

    made = {}
    if "ingredients" in names:
        new = rows.select(F.col("id").alias("recipe_id"), F.posexplode(F.col("ingredients").cast(f"array<{INGREDIENT}>")).alias("position", "v")).select("recipe_id", "position", "v.*")
        made["ingredients"] = swap(store.ingredients, "ingredients", new)
    if "instructions" in names:
        new = rows.select(F.col("id").alias("recipe_id"), F.inline(F.col("instructions").cast(f"array<{INSTRUCTION}>")))
        made["instructions"] = swap(store.instructions, "instructions", new)
    if "tags" in names:
        new = last_of(tag_rows(rows.where("tags is not null")), ["recipe_id", "domain", "label"], "position")
        made["tags"] = swap(store.tags, "tags", new)
    return replace(store, **made)


def updated(store: Store, patches: DataFrame, now: Column, device: str) -> tuple[Store, DataFrame]:
    """The store after `patches` (id and any of `PATCHED`; null: not supplied), and id, updated_at, error of each.

    A supplied field is found from then on; time and device change in any case. Records that
    are deleted or not there are errors. One patch an id. Each supplied field is logged.
    """
    given = [n for n in PATCHED if n in patches.columns]
    live = active(store.recipes).select("id").withColumn("there", F.lit(True))
    asked = patches.join(live, "id", "left")
    results = asked.select("id", F.when(F.col("there"), now.cast("string")).alias("updated_at"), F.when(F.col("there").isNull(), F.concat(F.lit("Recipe not found: "), "id")).alias("error"))
    good = asked.where("there").drop("there")
    prefixes = {n: p for n, p, _ in FIELDS}
    new = good.select("id", *(F.col(n).alias(f"new_{n}") for n in given), F.lit(True).alias("hit"))
    rows = store.recipes.join(new, "id", "left")
    change = {"updated_at": F.when(F.col("hit"), now.cast("string")).otherwise(F.col("updated_at")), "device_id": F.when(F.col("hit"), device).otherwise(F.col("device_id"))}
    for n in given:
        if n in prefixes or n == "notes":
            is_new = F.col(f"new_{n}").isNotNull()
            change[n] = F.coalesce(F.col(f"new_{n}").cast(store.recipes.schema[n].dataType), F.col(n))
            if n in prefixes:
                change[f"{prefixes[n]}_status"] = F.when(is_new, "found").otherwise(F.col(f"{prefixes[n]}_status"))
                change[f"{prefixes[n]}_justification"] = F.when(~is_new, F.col(f"{prefixes[n]}_justification"))
    recipes = rows.select(*(change.get(c, F.col(c)).alias(c) for c in store.recipes.columns))
    children = tuple(n for n in ("ingredients", "instructions", "tags") if n in given)
    out = _replaced(replace(store, recipes=recipes), good, children)
    values = good.select("id", F.lit(0).alias("seq"), *((F.to_json(n) if n in children else F.col(n).cast("string")).alias(n) for n in given))
    return replace(out, change_log=appended(store.change_log, _logged(values, tuple(given), now, device))), results


def soft_deleted(store: Store, ids: DataFrame, now: Column, device: str) -> tuple[Store, DataFrame]:
    """The store without the records of `ids`, which stay as deleted rows, and id, deleted (whether it was active) of each."""
    asked = ids.select("id").distinct()
    gone = active(store.recipes).join(asked, "id", "left_semi").select("id").withColumn("hit", F.lit(True))
    results = asked.join(gone, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("deleted"))
    change = {"deleted": F.lit(1), "updated_at": now.cast("string"), "device_id": F.lit(device)}
    rows = store.recipes.join(gone, "id", "left")
    recipes = rows.select(*((F.when(F.col("hit"), change[c]).otherwise(F.col(c)) if c in change else F.col(c)).alias(c) for c in store.recipes.columns))
    values = gone.select("id", F.lit(0).alias("seq"), F.lit("true").alias(DELETION))
    return replace(store, recipes=recipes, change_log=appended(store.change_log, _logged(values, (DELETION,), now, device))), results


def without_orphans(store: Store) -> Store:
    """The store without children of records that are not there."""
    owners = store.recipes.select(F.col("id").alias("recipe_id"))
    kept = lambda table: table.join(owners, "recipe_id", "left_semi").select(*table.columns)
    return replace(store, ingredients=kept(store.ingredients), instructions=kept(store.instructions), tags=kept(store.tags))


def outcome(results: DataFrame) -> DataFrame:
    """One row: imported, updated, skipped and the errors, in order, of save results (seq, created, error).

    Errors are as many as skipped items, which a report lists in full.
    """
    said = F.when(F.col("error").isNotNull(), F.struct("seq", F.concat(F.lit("Item "), F.col("seq").cast("string"), F.lit(": "), "error").alias("text")))
    return results.agg(
        F.count_if(F.col("created") & F.col("error").isNull()).alias("imported"),
        F.count_if(~F.col("created") & F.col("error").isNull()).alias("updated"),
        F.count_if(F.col("error").isNotNull()).alias("skipped"),
        F.transform(F.array_sort(F.collect_list(said)), lambda x: x["text"]).alias("errors"),
    )


def latest(log: DataFrame) -> DataFrame:
    """Last writer wins: of (record, field, value, at, device) the newest, ties by device.

    A null value that is newest stays, which a struct keeps apart from no value.
    """
    return log.groupBy("record", "field").agg(F.max_by(F.struct("value", "at"), F.struct("at", "device")).alias("v")).select("record", "field", F.col("v.value").alias("value"), F.col("v.at").alias("at"))


def merged_flags(log: DataFrame, deletion: str) -> DataFrame:
    """record, deleted: a deletion stands unless another field is strictly newer."""
    gone, alive = F.max(F.when(F.col("field") == deletion, F.col("at"))), F.max(F.when(F.col("field") != deletion, F.col("at")))
    return log.groupBy("record").agg((gone.isNotNull() & F.coalesce(alive <= gone, F.lit(True))).alias("deleted"))


def last_of(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row of each key: the one at the last position."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("v")).select(*keys, "v.*")
