"""Records as schema.org JSON, out and in, and snapshots of all tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import durations
from quernstone.operators import fields

from . import json_arrays

#: Fields of a record's nutrition, with their schema.org names, units and whether they are counts.
NUTRITION = [
    ("calories", "calories", "calories", True),
    ("fat_grams", "fatContent", "g", False),
    ("saturated_fat_grams", "saturatedFatContent", "g", False),
    ("carbs_grams", "carbohydrateContent", "g", False),
    ("fiber_grams", "fiberContent", "g", False),
    ("sugar_grams", "sugarContent", "g", False),
    ("protein_grams", "proteinContent", "g", False),
    ("sodium_mg", "sodiumContent", "mg", True),
]
DOMAINS = ("cuisine", "course", "diet")
_TAGS = "struct<" + ",".join(f"{d}:array<struct<label:string,confidence:double>>" for d in DOMAINS) + ">"
_PARSED = "array<struct<name:string,quantity:double,unit:string,raw_text:string>>"
#: Columns of a record that may be absent, which counts as null.
OPTIONAL = {
    "nutrition": "struct<" + ",".join(f"{n}:{'bigint' if count else 'double'}" for n, _, _, count in NUTRITION) + ">",
    "source": "string",
    "tags": _TAGS,
    "notes": "string",
    "ingredients_parsed": _PARSED,
}

_IN = (
    "`@context` string, `@type` string, name string, description string, recipeIngredient array<string>, recipeInstructions array<struct<`@type`:string,text:string,position:int>>, prepTime string, cookTime string, recipeYield string, url string, image array<string>, "
    f"nutrition struct<`@type`:string,{','.join(f'{p}:string' for _, p, _, _ in NUTRITION)}>, `x-extractionSource` string, `x-tags` {_TAGS}, `x-notes` string, "
    "`x-ingredientsParsed` array<struct<name:string,quantity:double,unit:string,rawText:string>>"
)


def exported(records: DataFrame) -> DataFrame:
    """id and json of records with id, title, description, ingredients, instructions (number, text), prep, cook, servings, url, images and the `OPTIONAL` columns.

    Name, description, tags and parsed ingredients are there even if null or empty;
    other null properties are left out, as are empty notes. Where a record has parsed
    ingredients their raw texts are its ingredients; else each text is its own name.
    """
    records = records.withColumns({n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in records.columns})
    steps = F.transform("instructions", lambda s: F.struct(F.lit("HowToStep").alias("@type"), s["text"].alias("text"), s["step_number"].alias("position")))
    parsed = F.coalesce(F.col("ingredients_parsed").cast(_PARSED), _unparsed(F.col("ingredients")), F.array().cast(_PARSED))
    facts = F.struct(F.lit("NutritionInformation").alias("@type"), *(durations.with_unit(F.col(f"nutrition.{n}"), unit).alias(p) for n, p, unit, _ in NUTRITION))
    tags = F.struct(*(F.coalesce(F.col(f"tags.{d}"), F.array()).cast("array<struct<label:string,confidence:double>>").alias(d) for d in DOMAINS))
    always = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Recipe").alias("@type"), F.col("title").alias("name"), "description"), {"ignoreNullFields": "false"})
    rest = F.to_json(
        F.struct(
            F.transform(parsed, lambda i: i["raw_text"]).alias("recipeIngredient"),
            F.coalesce(steps, F.array().cast("array<struct<`@type`:string,text:string,position:int>>")).alias("recipeInstructions"),
            durations.export_minutes(F.col("prep")).alias("prepTime"),
            durations.export_minutes(F.col("cook")).alias("cookTime"),
            F.col("servings").alias("recipeYield"),
            F.when(F.size("images") > 0, F.col("images")).alias("image"),
            F.when(F.col("nutrition").isNotNull(), facts).alias("nutrition"),
            "url",
            F.col("source").alias("x-extractionSource"),
            tags.alias("x-tags"),
            F.nullif("notes", F.lit("")).alias("x-notes"),
            F.transform(parsed, lambda i: F.struct(i["name"].alias("name"), i["quantity"].alias("quantity"), i["unit"].alias("unit"), i["raw_text"].alias("rawText"))).alias("x-ingredientsParsed"),
        )
    )
    return records.select("id", _joined(always, rest).alias("json"))


def _unparsed(texts: Column) -> Column:
    """Ingredients as they were written: each text is its own name."""
    none = F.lit(None)
    return F.transform(texts, lambda t: F.struct(t.alias("name"), none.cast("double").alias("quantity"), none.cast("string").alias("unit"), t.alias("raw_text")))


def _joined(first: Column, second: Column) -> Column:
    """One JSON object of two non-empty ones."""
    return F.concat(F.regexp_replace(first, r"\}$", ","), F.substring(second, 2, 1 << 30))


def imported(lines: DataFrame, json_col: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """The record of every JSON text, or in `error` what it lacks; no row is dropped.

    Context, type, ingredients and steps with type, text and position are required; so
    are the type of nutrition, the three lists of tags with label and confidence, and name
    and raw text of parsed ingredients where these are there. A record without url gets
    one from its title's hash, one without a known source `json_ld`, without tags empty
    lists. Confidences are kept within 0 and 1. Notes are handed on, which the reference
    reads and drops.
    """
    df = lines.select(*keep, F.col(f"`{json_col}`").alias("json"))
    # Through a generator, so that no filter or projection above parses a text again for each field it reads.
    df = df.select("*", F.explode(F.array(F.from_json("json", _IN, {"mode": "PERMISSIVE"}))).alias("r"))
    step_ok = lambda s: s["@type"].isNotNull() & s["text"].isNotNull() & s["position"].isNotNull()
    tag_ok = lambda t: t["label"].isNotNull() & t["confidence"].isNotNull()
    parsed_ok = lambda i: i["name"].isNotNull() & i["rawText"].isNotNull()
    error = F.when(F.try_parse_json("json").isNull(), "not JSON").otherwise(
        F.concat_ws(
            ", ",
            *(F.when(F.col(f"r.`{n}`").isNull(), f"missing {n}") for n in ("@context", "@type", "recipeIngredient", "recipeInstructions")),
            F.when(~F.forall("r.recipeInstructions", step_ok), "incomplete step"),
            *(F.when(F.get_json_object("json", f"$['{n}']").isNotNull() & F.col(f"r.`{n}`").isNull(), f"unreadable {n}") for n in ("nutrition", "x-tags", "x-ingredientsParsed")),
            F.when(F.col("r.nutrition").isNotNull() & F.col("r.nutrition.`@type`").isNull(), "nutrition without type"),
            *(F.when(F.col("r.`x-tags`").isNotNull() & ~F.coalesce(F.forall(F.col(f"r.`x-tags`.{d}"), tag_ok), F.lit(False)), f"incomplete {d} tags") for d in DOMAINS),
            F.when(~F.forall("r.`x-ingredientsParsed`", parsed_ok), "incomplete parsed ingredient"),
        )
    )
    url = F.coalesce("r.url", F.concat(F.lit("import://title-hash/"), F.lower(F.lpad(F.hex(F.xxhash64("r.name")), 16, "0"))))
    parsed = F.transform("r.`x-ingredientsParsed`", lambda i: F.struct(i["name"].alias("name"), i["quantity"].alias("quantity"), i["unit"].alias("unit"), i["rawText"].alias("raw_text")))
    parsed = F.coalesce(parsed, _unparsed(F.col("r.recipeIngredient")))
    facts = F.struct(*((durations.first_count if count else durations.first_float)(F.col(f"r.nutrition.{p}")).alias(n) for n, p, _, count in NUTRITION))
    clamped = lambda t: F.struct(t["label"].alias("label"), F.least(F.greatest(t["confidence"], F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    tags = F.struct(*(F.coalesce(F.transform(F.col(f"r.`x-tags`.{d}"), clamped), F.array().cast("array<struct<label:string,confidence:double>>")).alias(d) for d in DOMAINS))
    source = F.col("r.`x-extractionSource`")
    return df.select(
        *keep,
        F.col("r.name").alias("title"),
        F.col("r.description").alias("description"),
        F.transform(parsed, lambda i: i["raw_text"]).alias("ingredients"),
        F.transform("r.recipeInstructions", lambda s: F.struct(s["position"].alias("step_number"), s["text"].alias("text"))).alias("instructions"),
        durations.import_minutes(F.col("r.prepTime")).alias("prep"),
        durations.import_minutes(F.col("r.cookTime")).alias("cook"),
        F.col("r.recipeYield").alias("servings"),
        url.alias("url"),
        F.col("r.image").alias("images"),
        F.when(F.col("r.nutrition").isNotNull(), facts).alias("nutrition"),
        F.when(source.isin("microdata", "ai_fallback"), source).otherwise("json_ld").alias("source"),
        tags.alias("tags"),
        F.col("r.`x-notes`").alias("notes"),
        parsed.alias("ingredients_parsed"),
        F.nullif(error, F.lit("")).alias("error"),
    )


def written_array(records: DataFrame, folder: str) -> None:
    """Exported records (id, json) as one JSON array, in one file, a record a line, by id.

    One file has one writer; use `records.write.text` where JSON lines will do.
    """
    place = F.row_number().over(Window.orderBy("id", "json"))
    rows = records.select(F.col("id").cast("string").alias("id"), "json").withColumn("k", place)
    # Every record but the first follows a comma.
    rows = rows.select("k", F.when(F.col("k") > 1, F.concat(F.lit(","), "json")).otherwise(F.col("json")).alias("value"))
    ends = records.sparkSession.createDataFrame([(0, "["), (1 << 30, "]")], "k int, value string")
    rows.unionByName(ends).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(folder)


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """at (from 0) and json of every element of the JSON array in each file of `path`; a file that is none is an error."""
    found = json_arrays.elements(spark, path).select("at", F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<variant>").alias("items"))
    one = F.when(F.coalesce(F.size("items"), F.lit(0)) != 1, F.raise_error(F.lit(json_arrays.NO_ARRAY))).otherwise(F.col("items"))
    return found.select("at", F.explode(F.transform(one, lambda v: F.to_json(v))).alias("json"))


def imported_file(spark: SparkSession, path: str) -> DataFrame:
    """`imported` over the elements of a JSON array file, with `at`, their place."""
    items = array_items(spark, path)
    return imported(items, keep=("at",))


def as_saves(rows: DataFrame) -> DataFrame:
    """Imported rows (with `at`) as saves of a store; what is missing was not found in the import."""
    gone = "Not found in import"
    return rows.select(
        F.col("url").alias("source_url"),
        F.col("at").alias("seq"),
        *(fields.field(F.col(c), gone).alias(n) for n, c in (("title", "title"), ("description", "description"), ("servings", "servings"), ("prep_time_minutes", "prep"), ("cook_time_minutes", "cook"), ("images", "images"), ("nutrition", "nutrition"))),
        "source",
        F.col("ingredients_parsed").alias("ingredients"),
        "instructions",
        "tags",
    )


def backed_up(tables: dict[str, DataFrame], folder: str) -> dict:
    """Writes a snapshot of every table below `folder`; its count of active recipes, path and bytes."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return {"recipe_count": _active(spark.read.parquet(f"{folder}/recipes.parquet")), "file_path": folder, "file_size_bytes": size}


def _active(recipes: DataFrame) -> int:
    return (recipes.where("deleted = 0") if "deleted" in recipes.columns else recipes).count()


def restored(spark: SparkSession, folder: str, names: list[str], needed: str = "recipes") -> tuple[dict[str, DataFrame], int]:
    """The tables of a snapshot and its count of active recipes; a folder without `recipes` is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{needed}.parquet")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise ValueError(f"Invalid backup: no {needed} table found")
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
    return tables, _active(spark.read.parquet(f"{folder}/{needed}.parquet"))
