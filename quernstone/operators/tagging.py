"""Scored labels from vocabularies: cuisine, course and diet of a record.

Records have id, title, description, ingredients and instructions (arrays of texts).
Vocabularies are lists that the caller gives or loads from a file: large word lists are
data, not code. They are part of the plan, as an array of one struct per label, and so
are dictionaries of ingredients as long as they have few entries. A record is scored
within its row: no join, no shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 0.5
TAG = "struct<label:string,ord:int,confidence:double>"

# Prefixes of ingredient names; the first that fits is taken off.
PREFIXES = [
    "organic", "fresh", "dried", "ground", "chopped", "minced", "diced", "sliced", "shredded", "frozen", "canned", "raw", "cooked", "boneless",
    "skinless", "boneless skinless", "extra-virgin", "pure", "unsweetened", "roasted", "toasted", "crushed", "grated", "melted", "softened",
]

# What ingredients can be flagged with.
FLAGS = [
    "ContainsMeat", "ContainsPoultry", "ContainsFish", "ContainsDairy", "ContainsEggs", "ContainsGluten", "ContainsNuts", "ContainsSoy",
    "HighCarb", "HighFat", "ContainsSugar",
]

# Flags that each diet excludes, in the order that breaks ties.
DIETS = [
    ("vegan", ["ContainsMeat", "ContainsPoultry", "ContainsFish", "ContainsDairy", "ContainsEggs"]),
    ("vegetarian", ["ContainsMeat", "ContainsPoultry", "ContainsFish"]),
    ("pescatarian", ["ContainsMeat", "ContainsPoultry"]),
    ("gluten-free", ["ContainsGluten"]),
    ("dairy-free", ["ContainsDairy"]),
    ("nut-free", ["ContainsNuts"]),
    ("egg-free", ["ContainsEggs"]),
    ("soy-free", ["ContainsSoy"]),
    ("keto", ["HighCarb", "ContainsSugar"]),
    ("paleo", ["ContainsGluten", "ContainsDairy", "ContainsSoy", "ContainsSugar"]),
    ("whole30", ["ContainsGluten", "ContainsDairy", "ContainsSoy", "ContainsSugar"]),
    ("low-carb", ["HighCarb"]),
    ("low-fat", ["HighFat"]),
    ("sugar-free", ["ContainsSugar"]),
    ("Mediterranean diet", ["HighFat", "ContainsSugar"]),
]


@dataclass(frozen=True)
class Vocabulary:
    """Labels with their words, and the dictionaries of ingredients.

    cuisines and courses: (label, title words, ingredient words, step words) in the order
    that breaks ties. aliases: name to canonical name. flags: canonical name to flags.
    """

    cuisines: list[tuple] = field(default_factory=list)
    courses: list[tuple] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    flags: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if odd := {f for fs in self.flags.values() for f in fs} - set(FLAGS):
            raise ValueError(f"unknown flags {sorted(odd)}")


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a JSON file with the lists and dictionaries of `Vocabulary` by name."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    return Vocabulary(*([tuple(row) for row in found.get(n, [])] for n in ("cuisines", "courses")), found.get("aliases", {}), found.get("flags", {}))


def _lower(texts: Column) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.lower(F.coalesce(x, F.lit(""))))


def _hits(words: Column, test) -> Column:
    return F.size(F.filter(words, test))


def _lines() -> dict[str, Column]:
    return {
        "title_": F.lower(F.coalesce("title", F.lit(""))),
        "about_": F.lower(F.coalesce("description", F.lit(""))),
        "parts_": _lower(F.col("ingredients")),
        "steps_": F.array_join(_lower(F.col("instructions")), " "),
    }


def finalized(tags: Column) -> Column:
    """Tags (label, ord, confidence) at or above the threshold, surest first, ties by ord."""
    rows = F.transform(F.filter(tags, lambda t: t["confidence"] >= LEAST), lambda t: F.struct((-t["confidence"]).alias("k"), t["ord"].alias("ord"), t["label"].alias("label"), t["confidence"].alias("confidence")))
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["label"].alias("label"), x["ord"].alias("ord"), x["confidence"].alias("confidence"))).cast(f"array<{TAG}>")


def _scored(words: list[tuple], score) -> Column:
    """The finalized tags of a vocabulary; `score` takes title, ingredient and step words of a label."""
    texts = lambda ws: F.array(*map(F.lit, ws)).cast("array<string>")
    if not words:
        return F.array().cast(f"array<{TAG}>")
    labels = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(i).alias("ord"), texts(t).alias("t"), texts(p).alias("p"), texts(s).alias("s")) for i, (n, t, p, s) in enumerate(words)))
    return finalized(F.transform(labels, lambda v: F.struct(v["label"].alias("label"), v["ord"].alias("ord"), score(v["t"], v["p"], v["s"]).alias("confidence"))))


def _named(words: Column, text: str) -> Column:
    return F.exists(words, lambda w: F.col(text).contains(w)).cast("double")


def _in_parts(words: Column) -> Column:
    return F.least(_hits(words, lambda w: F.exists("parts_", lambda p: p.contains(w))) / F.lit(2.0), F.lit(1.0))


def cuisine_tags(words: list[tuple]) -> Column:
    """Tags by title, ingredients and instructions, of a row with the columns of `_lines`."""
    steps = lambda s: F.least(_hits(s, lambda w: F.col("steps_").contains(w)).cast("double"), F.lit(1.0))
    return _scored(words, lambda t, p, s: F.lit(0.35) * _named(t, "title_") + F.lit(0.35) * _in_parts(p) + F.lit(0.30) * steps(s))


def course_tags(words: list[tuple]) -> Column:
    """As `cuisine_tags`; title words are also looked for in the description, step words in title, description and instructions together."""
    whole = F.concat_ws(" ", "title_", "about_", "steps_")
    context = lambda s: F.least(_hits(s, lambda w: whole.contains(w)).cast("double"), F.lit(1.0))
    return _scored(words, lambda t, p, s: F.lit(0.40) * _named(t, "title_") + F.lit(0.25) * _in_parts(p) + F.lit(0.20) * _named(t, "about_") + F.lit(0.15) * context(s))


def normal_part(name: Column) -> Column:
    """Lower case without the first prefix that fits."""
    pattern = "^(?:" + "|".join(p + " " for p in PREFIXES) + ")"
    return F.regexp_replace(F.trim(F.lower(name)), pattern, "")


def _map(entries: dict, kind: str) -> Column:
    return F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)))).cast(kind) if entries else F.create_map().cast(kind)


def canonical_part(name: Column, aliases: dict[str, str]) -> Column:
    """The normal name's canonical one, else itself."""
    name = normal_part(name)
    return F.coalesce(F.try_element_at(_map(aliases, "map<string,string>"), name), name)


def diet_confidence(unknown: Column) -> Column:
    """1 less 0.2 for each ingredient without flags of its own, one after the other."""
    rest = F.aggregate(F.sequence(F.lit(1), unknown), F.lit(1.0), lambda c, _: c - F.lit(0.2))
    return F.when(unknown == 0, 1.0).when(unknown >= 5, 0.0).otherwise(rest)


def _diets(seen: Column, unknown: Column) -> Column:
    table = F.array(*(F.struct(F.lit(n).alias("label"), F.lit(i).alias("ord"), F.array(*map(F.lit, x)).alias("out")) for i, (n, x) in enumerate(DIETS)))
    kept = F.filter(table, lambda d: ~F.arrays_overlap(seen, d["out"]))
    return finalized(F.transform(kept, lambda d: F.struct(d["label"].alias("label"), d["ord"].alias("ord"), diet_confidence(unknown).alias("confidence"))))


def diet_tags(aliases: dict[str, str], flags: dict[str, list[str]], strict: bool = False) -> Column:
    """Diets of a row's `ingredients`; those without any have none.

    An excluded flag rules a diet out; every unknown ingredient takes 0.2 off. With
    `strict` a record with an unknown ingredient has no diet.
    """
    names = F.filter(F.coalesce("ingredients", F.array().cast("array<string>")), lambda x: x.isNotNull())
    known = F.transform(names, lambda x: F.try_element_at(_map(flags, "map<string,array<string>>"), canonical_part(x, aliases)))
    seen = F.flatten(F.filter(known, lambda x: x.isNotNull()))
    unknown = _hits(known, lambda x: x.isNull())
    some = (F.size(names) > 0) & (F.lit(not strict) | (unknown == 0))
    return F.when(some, _diets(seen, unknown)).otherwise(F.array().cast(f"array<{TAG}>"))


def refined_cuisines(tags: Column) -> Column:
    """Cuisines whose label stands in title and ingredients, times 1.2 up to 1."""
    parts = F.array_join("parts_", " ")
    twice = lambda t: F.col("title_").contains(F.lower(t["label"])) & parts.contains(F.lower(t["label"]))
    return finalized(_raised(tags, twice))


def refined_courses(tags: Column, cuisines: Column) -> Column:
    """Appetizer and snack of a Chinese dim sum, times 1.2 up to 1."""
    small = F.exists(cuisines, lambda t: t["label"] == "Chinese") & F.col("title_").contains("dim sum")
    return finalized(_raised(tags, lambda t: small & t["label"].isin("appetizer", "snack")))


def _raised(tags: Column, test) -> Column:
    return F.transform(tags, lambda t: F.struct(t["label"].alias("label"), t["ord"].alias("ord"), F.when(test(t), F.least(t["confidence"] * 1.2, F.lit(1.0))).otherwise(t["confidence"]).alias("confidence")))


def tagged(records: DataFrame, words: Vocabulary, refine: bool = False) -> DataFrame:
    """`records` with `tags`: arrays cuisine, course and diet of (label, ord, confidence), surest first.

    Refining can raise cuisines and courses that are there already, never a diet.
    """
    rows = records.withColumns(_lines())
    rows = rows.withColumns({"cuisine_": cuisine_tags(words.cuisines), "course_": course_tags(words.courses), "diet_": diet_tags(words.aliases, words.flags)})
    if refine:
        rows = rows.withColumn("cuisine_", refined_cuisines(F.col("cuisine_")))
        rows = rows.withColumn("course_", refined_courses(F.col("course_"), F.col("cuisine_")))
    return rows.select(*records.columns, F.struct(*(F.col(f"{d}_").alias(d) for d in ("cuisine", "course", "diet"))).alias("tags"))


def tagged_pages(extracted: DataFrame, words: Vocabulary) -> DataFrame:
    """Extracted records with `tags`, unrefined; null where no record was found."""
    texts = {
        "title": F.col("title.value"),
        "description": F.col("description.value"),
        "ingredients": F.col("ingredients"),
        "instructions": F.transform("instructions", lambda s: s["text"]),
    }
    rows = extracted.select(F.struct("*").alias("record"), *(c.alias(n) for n, c in texts.items()))
    done = tagged(rows, words)
    return done.select("record.*", F.when(F.col("record.error_type").isNull(), F.col("tags")).alias("tags"))


def tag_lists(df: DataFrame, tags: Column, domain: str) -> DataFrame:
    """id, domain, label, ord, confidence of every tag of a column."""
    return df.select("id", F.lit(domain).alias("domain"), F.inline(tags))


def cuisines(df: DataFrame, words: list[tuple]) -> DataFrame:
    return tag_lists(df.withColumns(_lines()), cuisine_tags(words), "cuisine")


def courses(df: DataFrame, words: list[tuple]) -> DataFrame:
    return tag_lists(df.withColumns(_lines()), course_tags(words), "course")


def diets(df: DataFrame, aliases: dict[str, str], flags: dict[str, list[str]], strict: bool = False) -> DataFrame:
    return tag_lists(df, diet_tags(aliases, flags, strict), "diet")


#: Entries up to which a dictionary is part of the plan.
MOST_ENTRIES = 2000


def dictionaries(spark: SparkSession, aliases: DataFrame, flags: DataFrame) -> tuple[dict, dict] | None:
    """Dictionaries of tables (name, canonical) and (canonical, flags), null if they are too long to be part of a plan."""
    found = [df.limit(MOST_ENTRIES + 1).collect() for df in (aliases, flags)]
    return None if max(map(len, found)) > MOST_ENTRIES else ({r["name"]: r["canonical"] for r in found[0]}, {r["canonical"]: list(r["flags"]) for r in found[1]})


def diets_by_tables(df: DataFrame, aliases: DataFrame, flags: DataFrame) -> DataFrame:
    """`diets` with dictionaries as tables of one row a name: within the row if they are short, else by joins.

    The joins meet distinct names first, so that a name that many records hold is looked
    up once; adaptive execution splits what stays uneven.
    """
    if short := dictionaries(df.sparkSession, aliases, flags):
        return diets(df, *short)
    parts = df.select("id", F.explode(F.filter("ingredients", lambda x: x.isNotNull())).alias("raw")).withColumn("name", normal_part(F.col("raw")))
    names = parts.select("name").distinct().join(aliases, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))
    known = parts.join(names.join(flags, "canonical", "left").select("name", "flags"), "name", "left")
    seen = known.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("flags"))).alias("seen"), F.count_if(F.col("flags").isNull()).cast("int").alias("unknown"))
    return tag_lists(seen, _diets(F.col("seen"), F.col("unknown")), "diet")
