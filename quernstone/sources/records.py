"""Recipe records out of web pages: JSON-LD scripts first, then microdata.

One Arrow pass parses HTML into plain values; durations, numbers and the status of
each field are column expressions above it. A page that fails has an error in its row. Pages without a script or an item
type hold no record and do not leave the JVM; Arrow batches are bounded in bytes by Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernstone.functions import durations

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Nutrition columns and the properties they are read from.
NUTRITION = [
    ("calories", "calories"), ("fat_grams", "fatContent"), ("saturated_fat_grams", "saturatedFatContent"), ("carbs_grams", "carbohydrateContent"),
    ("fiber_grams", "fiberContent"), ("sugar_grams", "sugarContent"), ("protein_grams", "proteinContent"), ("sodium_mg", "sodiumContent"),
]
RAW = "source string, title string, description string, ingredients array<string>, steps array<struct<step_number:int,text:string>>, prep string, cook string, servings string, images array<string>, nutrition map<string,double>"


class _Tree(HTMLParser):
    """Elements in document order; each knows where its descendants and texts end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in reversed(attrs)}, "at": len(self.nodes), "text": len(self.texts), "end": None}
        self.nodes.append(node)
        if tag in _VOID:
            node["end"] = (len(self.nodes), len(self.texts))
        else:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.open):
            while True:
                node = self.open.pop()
                node["end"] = (len(self.nodes), len(self.texts))
                if node["tag"] == tag:
                    break

    def handle_data(self, data):
        self.texts.append(data)

    def below(self, node):
        return self.nodes[node["at"] + 1 : node["end"][0] if node["end"] else None]

    def text(self, node, between=" "):
        return between.join(self.texts[node["text"] : node["end"][1] if node["end"] else None]).strip()


def _parsed(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree


def _texts(value) -> list[str]:
    """Trimmed non-blank texts of a text or an array."""
    return [v.strip() for v in (value if isinstance(value, list) else [value]) if isinstance(v, str) and v.strip()]


def _is_recipe(value) -> bool:
    kinds = value.get("@type")
    return any(isinstance(k, str) and (k == "Recipe" or k.endswith("/Recipe")) for k in (kinds if isinstance(kinds, list) else [kinds]))


def _find(value):
    if isinstance(value, list):
        return next((found for v in value if (found := _find(v)) is not None), None)
    if not isinstance(value, dict):
        return None
    graph = value.get("@graph")
    members = [value] + (graph if isinstance(graph, list) else [])
    return next((m for m in members if isinstance(m, dict) and _is_recipe(m)), None)


def _number(value) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _step_text(step) -> str | None:
    return next((t for name in ("text", "name") for t in _texts(step.get(name))[:1] if isinstance(step.get(name), str)), None)


def _steps(value) -> list[tuple[int, str]]:
    if isinstance(value, str):  # numbers count blank lines too
        return [(i, line.strip()) for i, line in enumerate(value.splitlines(), 1) if line.strip()]
    out: list[str] = []
    for step in value if isinstance(value, list) else []:
        if isinstance(step, str):
            out += _texts(step)
        elif isinstance(step, dict):
            out += filter(None, [_step_text(step)])
            inner = step.get("itemListElement")
            out += filter(None, [_step_text(s) for s in (inner if isinstance(inner, list) else []) if isinstance(s, dict)])
    return list(enumerate(out, 1))


def _image(value) -> str | None:
    """The trimmed text, or an object's `url`, its `contentUrl` only where it has no `url`."""
    if isinstance(value, dict):
        value = value["url"] if "url" in value else value.get("contentUrl")
    return value.strip() or None if isinstance(value, str) else None


def _images(value) -> list[str]:
    return [t for v in (value if isinstance(value, list) else [value]) if (t := _image(v))]


def _amount(value) -> float | None:
    """A number as it is, or the one a text begins with; no space may precede it."""
    if _number(value):
        return float(value) if abs(value) < 1 << 1023 else None
    start = re.match("[0-9.]*", value)[0] if isinstance(value, str) else ""
    return float(start) if start.count(".") < 2 and start.strip(".") else None


def _duration(value) -> str | None:
    if isinstance(value, str):
        return value
    return None if not _number(value) else str(value) if isinstance(value, int) and value >= 0 else ""


def from_json(value: dict) -> dict:
    """Plain values of one JSON-LD recipe."""
    amount = value.get("recipeYield")
    servings = next((str(v).strip() for v in (amount if isinstance(amount, list) else [amount]) if _number(v) or _texts(v)), None)
    facts = value.get("nutrition")
    one = lambda name: next(iter(_texts(value.get(name))), None)
    return {
        "source": "json_ld",
        "title": one("name"),
        "description": one("description"),
        "ingredients": _texts(value["recipeIngredient"]) if isinstance(value.get("recipeIngredient"), list) else [],
        "steps": [{"step_number": i, "text": t} for i, t in _steps(value.get("recipeInstructions"))],
        "prep": _duration(value.get("prepTime")),
        "cook": _duration(value.get("cookTime")),
        "servings": servings or (one("yield") if isinstance(value.get("yield"), str) else None),
        "images": _images(value.get("image")),
        "nutrition": {n: a for n, p in NUTRITION if (a := _amount(facts.get(p))) is not None} if isinstance(facts, dict) else None if "nutrition" not in value else {},
    }


def _prop(tree: _Tree, node: dict, name: str) -> str | None:
    el = next((n for n in tree.below(node) if n["attrs"].get("itemprop") == name), None)
    return el and (next((t for a in ("content", "datetime", "value") if (t := el["attrs"].get(a, "").strip())), None) or tree.text(el) or None)


def from_microdata(tree: _Tree) -> dict | None:
    """Plain values of the page's recipe scope, null where there is none."""
    tests = (("schema.org/Recipe", True), ("Recipe", True), ("schema.org/Recipe", False))
    scope = next((n for word, scoped in tests for n in tree.nodes if word in n["attrs"].get("itemtype", "") and ("itemscope" in n["attrs"] or not scoped)), None)
    if scope is None:
        return None
    named = lambda name: [n for n in tree.below(scope) if n["attrs"].get("itemprop") == name]
    items = [t for n in named("recipeIngredient") if (t := tree.text(n))] or [t for n in named("ingredients") if (t := tree.text(n))]
    steps: list[str] = []
    for n in named("recipeInstructions"):
        if "itemscope" in n["attrs"]:
            steps += filter(None, [_prop(tree, n, "text") or _prop(tree, n, "name") or tree.text(n)])
        else:
            steps += [line.strip() for line in tree.text(n).splitlines() if line.strip()]
    within = next(iter(named("nutrition")), None)
    facts = within and {n: a for n, p in NUTRITION if (a := _amount(_prop(tree, within, p))) is not None}
    images = [t for n in named("image") if (t := next((n["attrs"][a].strip() for a in ("src", "href", "content") if n["attrs"].get(a, "").strip()), None))]
    return {
        "source": "microdata", "title": _prop(tree, scope, "name"), "description": _prop(tree, scope, "description"), "ingredients": items,
        "steps": [{"step_number": i, "text": t} for i, t in enumerate(steps, 1)], "prep": _prop(tree, scope, "prepTime"), "cook": _prop(tree, scope, "cookTime"),
        "servings": _prop(tree, scope, "recipeYield") or _prop(tree, scope, "yield"), "images": images, "nutrition": facts,
    }


def _has_content(r: dict | None) -> bool:
    return bool(r and (r["title"] or r["ingredients"] or r["steps"]))


# Why no record was found, by way of finding one.
NO_SCRIPTS, NO_SCHEMA, EMPTY_SCHEMA = "No JSON-LD scripts found", "No Recipe schema found in JSON-LD", "Recipe schema found but no content could be extracted"
NO_SCOPE, EMPTY_SCOPE = "No Recipe microdata itemscope found", "Recipe microdata found but no content could be extracted"
NO_RECIPE = "No structured recipe data found (JSON-LD or Microdata)"


def _of_scripts(tree: _Tree) -> tuple[dict | None, str | None]:
    """The record of the first script that holds a recipe, or why there is none; an empty recipe ends the search."""
    scripts = [t for n in tree.nodes if n["tag"] == "script" and n["attrs"].get("type") == "application/ld+json" and (t := tree.text(n, ""))]
    for text in scripts:
        try:
            found = _find(json.loads(text))
        except (ValueError, RecursionError):
            continue
        if found is not None:
            record = from_json(found)
            return (record, None) if _has_content(record) else (None, EMPTY_SCHEMA)
    return None, NO_SCHEMA if scripts else NO_SCRIPTS


def plain_record(html: str | None) -> tuple[dict | None, str | None, str | None]:
    """The first JSON-LD recipe if it has content, else the microdata's, else null; and why each way failed."""
    if not html:
        return None, NO_SCRIPTS, NO_SCOPE
    tree = _parsed(html)
    record, json_error = _of_scripts(tree)
    if record is not None:
        return record, None, None
    record = from_microdata(tree)
    if _has_content(record):
        return record, json_error, None
    return None, json_error, NO_SCOPE if record is None else EMPTY_SCOPE


def _field(value: Column, reason: str | Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.when(value.isNotNull(), "found").otherwise("not_found").alias("status"), value.alias("value"), F.when(value.isNull(), reason).alias("justification"))


def previewed(html: Column) -> Column:
    """The first 200 characters and three dots; a text of at most 200 bytes as it is."""
    html = F.coalesce(html, F.lit(""))
    return F.when(F.octet_length(html) > 200, F.concat(F.substring(html, 1, 200), F.lit("..."))).otherwise(html)


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, record fields with status and reason, and error_type (null: a record was found)."""
    html = F.col(f"`{html_col}`")
    low = F.lower(html)
    # Names of tags and attributes have no escapes, so no record is lost here.
    marked = low.contains("<script") | low.contains("itemtype")
    df = pages.select(F.col(f"`{id_col}`").alias("id"), previewed(html).alias("preview"), F.when(marked, html).alias("html"))
    raw = T._parse_datatype_string(RAW)
    out = T.StructType([*df.schema.fields[:2], T.StructField("r", raw), T.StructField("json_ld_error", T.StringType()), T.StructField("microdata_error", T.StringType())])
    schema = to_arrow_schema(out)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, json_errors, item_errors = zip(*(plain_record(t.as_py()) for t in b.column(2)), strict=True) if len(b) else ((), (), ())
            for r in found:
                if r and r["nutrition"] is not None:
                    r["nutrition"] = list(r["nutrition"].items())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(found, schema.field("r").type), pa.array(json_errors, pa.string()), pa.array(item_errors, pa.string())], schema=schema)

    r = df.mapInArrow(parse, out)
    gone, bad = "Not found in source", "Could not parse value"

    def minutes(name: str) -> Column:
        text = F.col(f"r.{name}")
        return _field(durations.flexible_minutes(text), F.when(text.isNull(), gone).otherwise(bad))

    number = {n: F.try_element_at("r.nutrition", F.lit(n)) for n, _ in NUTRITION}
    count = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(float((1 << 32) - 1)))).cast("bigint")  # noqa: E731  of 32 bits
    whole = {n: (count(c) if n in ("calories", "sodium_mg") else c) for n, c in number.items()}
    facts = F.when(F.coalesce(*(c.cast("double") for c in whole.values())).isNotNull(), F.struct(*(c.alias(n) for n, c in whole.items())))
    return r.select(
        "id",
        F.col("r.source").alias("source"),
        _field(F.col("r.title"), gone).alias("title"),
        _field(F.col("r.description"), gone).alias("description"),
        F.col("r.ingredients").alias("ingredients"),
        F.col("r.steps").alias("instructions"),
        minutes("prep").alias("prep_time_minutes"),
        minutes("cook").alias("cook_time_minutes"),
        _field(F.col("r.servings"), gone).alias("servings"),
        _field(F.when(F.size("r.images") > 0, F.col("r.images")), gone).alias("images"),
        _field(facts, F.when(F.col("r.nutrition").isNull(), "Not provided").otherwise(bad)).alias("nutrition"),
        F.when(F.col("r").isNull(), "no_recipe_found").alias("error_type"),
        F.when(F.col("r").isNull(), F.col("preview")).alias("html_preview"),
        F.when(F.col("r").isNull(), NO_RECIPE).alias("message"),
        "json_ld_error",
        "microdata_error",
    )
