"""Whole pages, crawl rules and scalar vectors of the kinds that the blueprint lists, written anew."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import durations
from quernstone.operators import fetching, robots, tagging
from quernstone.sources import interchange, records

COOKIES = """<!DOCTYPE html><html><head><title>Cookies</title>
<script type="application/ld+json">
{"@context": "https://schema.org", "@type": "Recipe", "name": "Oat Cookies", "description": "Crisp cookies for dessert.", "image": "https://ex.org/c.jpg",
 "recipeIngredient": ["1 cup oats", "half a cup sugar", "one egg", "butter", "vanilla", "chocolate chips"],
 "recipeInstructions": [{"@type": "HowToStep", "text": "Heat the oven."}, {"@type": "HowToStep", "text": "Mix all."}, {"@type": "HowToStep", "text": "Shape."}, {"@type": "HowToStep", "text": "Bake until golden."}],
 "prepTime": "PT15M", "cookTime": "PT12M", "recipeYield": "24 cookies",
 "nutrition": {"@type": "NutritionInformation", "calories": "220 calories", "fatContent": "11 g", "carbohydrateContent": "28 g", "proteinContent": "3 g"}}
</script></head><body><h1>Oat Cookies</h1></body></html>"""
STEPS = "".join(f'<div itemprop="recipeInstructions" itemscope itemtype="https://schema.org/HowToStep"><p itemprop="text">{t}</p></div>' for t in ("Heat the oven.", "Mix all.", "Shape.", "Bake until golden."))
PARTS = "".join(f'<li itemprop="recipeIngredient">{t}</li>' for t in ("1 cup oats", "half a cup sugar", "one egg", "butter", "vanilla", "chocolate chips"))
MARKED = f"""<html><body><article itemscope itemtype="https://schema.org/Recipe"><h1 itemprop="name">Oat Cookies</h1>
<meta itemprop="prepTime" content="PT15M"><meta itemprop="cookTime" content="PT12M"><span itemprop="recipeYield">24 cookies</span><ul>{PARTS}</ul>{STEPS}</article></body></html>"""
PAGES = {
    "json": COOKIES,
    "items": MARKED,
    "both": MARKED.replace("</body>", COOKIES.split("<head>")[1].split("</head>")[0].replace("Oat Cookies", "By script") + "</body>"),
    "none": "<html><nav>Home</nav><p>We love recipes and tell of them.</p></html>",
    "broken": '<script type="application/ld+json">{"@type": "Recipe", "name": </script>',
    "graph": '<script type="application/ld+json">{"@graph": [{"@type": "Person"}, {"@type": ["Recipe", "Thing"], "name": "G", "image": ["a", "b", "c"]}]}</script>',
}


def test_whole_pages(spark):
    found = {r.id: r for r in records.extracted(spark.createDataFrame(list(PAGES.items()), "page_id string, html string")).collect()}
    for name, source in (("json", "json_ld"), ("items", "microdata")):
        r = found[name]
        assert (r.source, r.title.value, len(r.ingredients), [s.step_number for s in r.instructions]) == (source, "Oat Cookies", 6, [1, 2, 3, 4])
        assert (r.prep_time_minutes.value, r.cook_time_minutes.value, r.servings.value) == (15, 12, "24 cookies")
    n = found["json"].nutrition.value
    assert (n.calories, n.fat_grams, n.carbs_grams, n.protein_grams, n.sodium_mg) == (220, 11.0, 28.0, 3.0, None)
    assert found["items"].nutrition.justification == "Not provided"
    assert (found["both"].title.value, found["both"].source) == ("By script", "json_ld")
    assert found["graph"].images.value == ["a", "b", "c"]
    assert found["none"].error_type == found["broken"].error_type == "no_recipe_found" and found["broken"].json_ld_error == records.NO_SCHEMA


WORDS = tagging.Vocabulary([], [("dessert", ["cookie", "cake"], ["sugar", "chocolate", "vanilla"], ["bake"])], {}, {})


def test_page_to_tags(spark):
    rows = records.extracted(spark.createDataFrame(list(PAGES.items()), "page_id string, html string"))
    found = {r.id: r.tags for r in tagging.tagged_pages(rows, WORDS).collect()}
    assert [t.label for t in found["json"].course] == [t.label for t in found["items"].course] == ["dessert"] and found["none"] is None


RULES = [
    ("User-agent: *\nAllow: /\n", "/x", True), ("User-agent: *\nDisallow: /\n", "/x", False), ("User-agent: RecipeScraper\nDisallow: /recipes\n", "/recipes/page", False), ("User-agent: Other\nDisallow: /\n", "/x", True),
    ("User-agent: *\nDisallow: /\nUser-agent: RecipeScraper\nAllow: /\n", "/x", True), ("User-agent: *\nDisallow: /a\nAllow: /a/b\n", "/a/b/c", True), ("User-agent: *\nDisallow: /*.pdf$\n", "/x.pdf", False), ("User-agent: *\nDisallow: /*.pdf$\n", "/x.pdf?q", True), ("", "/x", True),
]


def test_crawl_rules(spark):
    rows = spark.createDataFrame([(i, "ok", text, path, False) for i, (text, path, _) in enumerate(RULES)], "id int, status string, text string, path string, stale boolean")
    assert [r.allowed for r in robots.decided(rows).orderBy("id").collect()] == [want for *_, want in RULES]


def test_unknown_status_is_denied(spark):
    rows = spark.createDataFrame([("odd", "x", "/", True), ("unreachable", "", "/", False)], "status string, text string, path string, stale boolean")
    assert [(r.allowed, r.reason) for r in robots.decided(rows).collect()] == [(False, "unknown robots.txt status: odd (stale cache)"), (False, "robots.txt unreachable")]


@pytest.mark.parametrize(
    ("form", "vectors"),
    [
        (durations.iso_minutes, {"PT15M": 15, "PT2H": 120, "PT2H15M": 135, "PT30S": 1, "PT1M30S": 2, "PT0.5H": 30, "": None, "15": None, "P15M": None, "PT": None, "PTM": None, "pt5m": None}),
        (durations.flexible_minutes, {"PT1H30M": 90, "30": 30, " 15 minutes ": 15, "1 hour": 60, "1 hour 30 minutes": 7800, "-15": 15, "soon": None, "5d": 5}),
        (durations.import_minutes, {"PT1H30M": 90, "PT45M": 45, "PT2H": 120, "PT1H30": 60, "30M": 30, "PT1.5H": None, "x": None}),
    ],
)
def test_durations(spark, form, vectors):
    rows = spark.createDataFrame([(t,) for t in vectors], "t string")
    assert {r.t: r.m for r in rows.select("t", form(F.col("t")).alias("m")).collect()} == vectors


def test_http_messages(spark):
    rows = spark.createDataFrame([(404,), (503,), (418,)], "c int")
    assert [r.m for r in rows.select(fetching.http_message(F.col("c")).alias("m")).collect()] == ["Page not found (404)", "Service unavailable (503)", "HTTP error (418)"]


def test_damaged_snapshot_is_refused(spark, tmp_path):
    (tmp_path / "recipes.parquet").write_text("this is no table")
    with pytest.raises(Exception):  # noqa: B017  whatever the reader says
        interchange.restored(spark, str(tmp_path), ["recipes"])
