"""URLs, crawl rules, names of ingredients, tags and pages: the sharp edges one by one."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import urls
from quernstone.operators import fields, robots, tagging
from quernstone.sources import records


def test_urls(spark):
    cases = {
        "http://ex.org/a//": "http://ex.org/a/", "http://ex.org": "http://ex.org/", "HTTPS://EX.org:443/A?": "https://ex.org/A?", "http://ex.org:80#x": "http://ex.org/#x", "https://ex.org:80/": "https://ex.org:80/",
        " http://ex.org/a b ": "http://ex.org/a%20b", "http://user@ex.org/a": "http://ex.org/a", "http://EXÄ.org/": "http://xn--ex-wia.org/", "http://ex.org/a/%2e%2E/b": "http://ex.org/b", "http://ex.org\\a": "http://ex.org/a", "http://[::1]/": "http://[::1]/",
        "http://256.1.1.1/": None, "http://ex.org:70000/": None, "javascript://x": None, None: None, "ex.org": None, "http://a%00b/": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "url string")
    found = {r.url: (r.parts.normalized, r.parts.error) for r in urls.resolved(rows).collect()}
    assert {k: v for k, (v, _) in found.items()} == cases
    assert found[None][1] == "No URL provided" and found["ex.org"][1].startswith("Invalid URL: missing scheme") and found["javascript://x"][1] == "Invalid URL: scheme 'javascript' not allowed (only http and https)"
    assert all((v is None) == (e is not None) for v, e in found.values())


@pytest.mark.parametrize(
    ("text", "delay"),
    [("User-agent: *\nCrawl-delay: 5", 5.0), ("User-agent: *\nCrawl-delay: 5\nUser-agent: RecipeScraper\nCrawl-delay: 2.5", 2.5), ("User-agent: RecipeScraper\nUser-agent: x\nCrawl-delay: 3", None), ("User-agent: *\nCrawl-delay: 5 # s\nCrawl-delay: 7", 7.0), ("USER-AGENT: *\nCrawl-delay: 5", None)],
)
def test_crawl_delay(spark, text, delay):
    assert spark.range(1).select(robots.crawl_delay(F.lit(text)).alias("d")).first().d == delay


def test_fetch_status_denies_what_is_not_missing(spark):
    rows = spark.createDataFrame([(404, 0), (410, 0), (401, 0), (500, 0), (None, 0), (301, 0), (200, 600_000), (200, 5)], "code int, n int")
    assert [r.s for r in rows.select(robots.fetch_status(F.col("code"), F.col("n")).alias("s")).collect()] == ["not_found", "not_found", "unreachable", "unreachable", "unreachable", "unreachable", "oversized", "ok"]


def test_ingredient_prefixes(spark):
    names = ["Boneless skinless chicken breast", "fresh organic basil", " Ground beef", "freshly"]
    found = [spark.range(1).select(tagging.normal_part(F.lit(n)).alias("n")).first().n for n in names]
    assert found == ["skinless chicken breast", "organic basil", "beef", "freshly"]


WORDS = tagging.Vocabulary(
    [("Thai", ["thai"], ["basil", "ice"], ["wok"]), ("Chinese", ["dim sum"], ["soy", "pork"], [])],
    [("snack", ["snack", "sum"], ["pork", "soy"], ["fry"])],
    {"butter": "butter", "steak": "beef"},
    {"butter": ["ContainsDairy", "HighFat"], "beef": ["ContainsMeat"], "salt": []},
)
DISHES = "id int, title string, description string, ingredients array<string>, instructions array<string>"


def tags(spark, *row, **options):
    return tagging.tagged(spark.createDataFrame([(1, *row)], DISHES), WORDS, **options).first().tags


def test_tags_by_substring_and_threshold(spark):
    assert tags(spark, "Thai dish", None, [], None).cuisine == []  # a title alone is not enough
    found = tags(spark, "Thai dish", None, ["Rice"], None).cuisine  # "ice" is in "rice"
    assert [(t.label, round(t.confidence, 6)) for t in found] == [("Thai", 0.525)]
    assert tags(spark, None, None, None, None) == ([], [], [])


def test_diets(spark):
    labels = lambda parts, **kw: {t.label: round(t.confidence, 6) for t in spark.createDataFrame([(parts,)], "ingredients array<string>").select(tagging.diet_tags(WORDS.aliases, WORDS.flags, **kw).alias("t")).first().t}
    assert labels([]) == {} and len(labels(["salt"])) == 15
    assert "vegan" not in labels(["Melted butter"]) and "low-fat" not in labels(["butter"]) and labels(["butter"])["vegetarian"] == 1.0
    assert set(labels(["2 cups flour", "x"]).values()) == {0.6} and labels(["a", "b", "c"]) == {}
    assert labels(["x"], strict=True) == {} and len(labels(["salt"], strict=True)) == 15


def test_diets_by_tables_match(spark):
    rows = spark.createDataFrame([(1, ["Steak", "salt"]), (2, ["butter", "x", "x"]), (3, ["salt", None])], "id int, ingredients array<string>")
    aliases = spark.createDataFrame(list(WORDS.aliases.items()), "name string, canonical string")
    flags = spark.createDataFrame(list(WORDS.flags.items()), "canonical string, flags array<string>")
    got = [sorted(map(tuple, tagging.diets_by_tables(rows, aliases, flags).collect()))]
    most, tagging.MOST_ENTRIES = tagging.MOST_ENTRIES, 1
    try:
        got.append(sorted(map(tuple, tagging.diets_by_tables(rows, aliases, flags).collect())))
    finally:
        tagging.MOST_ENTRIES = most
    assert got[0] == got[1] and {r[0] for r in got[0]} == {1, 2, 3}


def test_refining(spark):
    row = ("Dim sum", None, ["pork", "soy"], ["fry"])
    plain, refined = tags(spark, *row), tags(spark, *row, refine=True)
    assert [t.confidence for t in plain.course] == pytest.approx([0.8]) and [t.confidence for t in refined.course] == pytest.approx([0.96])
    both = tags(spark, "Thai curry", None, ["thai basil", "ice"], None, refine=True).cuisine
    assert both[0].confidence == pytest.approx(0.84) and tags(spark, "Thai", None, ["thai basil", "ice"], ["wok"], refine=True).cuisine[0].confidence == 1.0


def test_flags_are_checked():
    with pytest.raises(ValueError, match="unknown flags"):
        tagging.Vocabulary(flags={"milk": ["Dairy"]})


def page(value):
    return f'<script type="application/ld+json">{value}</script>'


def test_pages(spark):
    pages = [
        page('{"@type": "Recipe", "image": "x"}') + page('{"@type": "Recipe", "name": "second"}'),
        page('{"@type": "Recipe", "name": "n", "prepTime": "P1DT2H", "cookTime": "-15", "nutrition": {"calories": "1,200", "fatContent": " 3 g"}}'),
        '<div itemscope itemtype="https://schema.org/Recipe"><span itemprop="name"> </span><span itemprop="name">b</span><p itemprop="ingredients">salt</p></div>',
        "short",
        None,
    ]
    found = records.extracted(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).orderBy("id").collect()
    assert [r.error_type for r in found] == ["no_recipe_found", None, None, "no_recipe_found", "no_recipe_found"]
    assert found[0].json_ld_error == records.EMPTY_SCHEMA and found[0].microdata_error == records.NO_SCOPE  # an empty first recipe ends the search
    assert (found[1].prep_time_minutes.value, found[1].cook_time_minutes.value, found[1].nutrition.value.calories, found[1].nutrition.value.fat_grams) == (12, 15, 1, None)
    assert found[2].title == ("not_found", None, fields.NOT_FOUND) and found[2].ingredients == ["salt"]
    assert found[3].html_preview == "short" and found[4].html_preview == ""


def test_fields_as_json(spark):
    row = spark.range(1).select(fields.tagged(fields.field(F.lit("x"))).alias("a"), fields.tagged(fields.field(F.lit(None).cast("int"), fields.UNPARSED)).alias("b"), fields.untagged(F.lit('{"status":"found"}'), "int").alias("c"), fields.device_id(F.lit("/p")).alias("d")).first()
    assert row.a == '{"status":"found","value":"x"}' and row.b == '{"status":"not_found","justification":"Could not parse value"}' and row.c is None and len(row.d) == 23
