"""The commands of a stored collection, one after the other."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.collection import Collection
from quernstone.functions import urls
from quernstone.operators import fields, store


def test_commands(spark, tmp_path):
    now = F.lit("2024-01-01T00:00:00.000000Z")
    mine, theirs = (Collection(spark, str(tmp_path / n), n, now) for n in ("mine", "theirs"))
    good = {"@context": "c", "@type": "Recipe", "name": "Soup", "recipeIngredient": ["salt"], "recipeInstructions": [{"@type": "HowToStep", "text": "stir", "position": 1}], "url": "http://x/1"}
    (tmp_path / "in.json").write_text(json.dumps([good, good | {"url": "http://x/2", "name": "Stew"}, {}]))
    said = mine.import_file(str(tmp_path / "in.json")).first()
    assert (said.imported, said.updated, said.skipped) == (2, 0, 1)
    rows = {r.title: r.id for r in mine.list().collect()}
    assert set(rows) == {"Soup", "Stew"} and [r.title for r in mine.search("SOUP").collect()] == ["Soup"]

    patch = spark.createDataFrame([(rows["Soup"], "Broth")], "id string, title string")
    assert mine.update(patch).first().error is None
    ids = spark.createDataFrame([(rows["Soup"],)], "id string")
    assert mine.get(ids).first().title.value == "Broth"
    assert mine.export(str(tmp_path / "out"), ids) == 1 and mine.export(str(tmp_path / "all")) == 2
    with pytest.raises(LookupError, match="Recipe not found: no"):
        mine.export(str(tmp_path / "out"), spark.createDataFrame([("no",)], "id string"))

    assert theirs.import_file(str(tmp_path / "all")).first().imported == 2
    theirs.now = F.lit("9999-12-31T00:00:00.000000Z")
    other = {r.title: r.id for r in theirs.list().collect()}
    theirs.update(spark.createDataFrame([(other["Stew"], "Newer note")], "id string, notes string"))
    shared = str(tmp_path / "shared")
    first = theirs.sync(shared).first()
    assert first.exported > 0 and first.imported == first.merged == 0
    back = mine.sync(shared).first()
    assert back.exported > 0 and back.imported == first.exported and back.merged == 2
    found = {r.title.value: r.notes for r in store.assembled(mine.tables).collect()}
    assert found["Stew"] == "Newer note"
    again = mine.sync(shared).first()
    assert (again.exported, again.imported) == (0, 0) and mine.sync_status().first().devices == ["theirs"] and mine.sync_status().first().pending == 0

    said = mine.backup(str(tmp_path / "backup"))
    assert mine.delete(ids).first().deleted and mine.list().count() == 1
    assert mine.restore(str(tmp_path / "backup")) == said["recipe_count"] == 2 and mine.list().count() == 2
    assert Collection(spark, str(tmp_path / "mine")).list().count() == 2  # opened again


def test_pages_of_a_collection(spark, tmp_path):
    it = Collection(spark, str(tmp_path / "c"), now=F.lit("2024"))
    asked = it.validate_urls(spark.createDataFrame([("http://ex.org/a",), ("no",)], "url string")).collect()
    assert [r.parts.error is None for r in asked] == [True, False] and it.device.startswith("device-")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    requests = urls.resolved(spark.createDataFrame([("http://ex.org/a",)], "url string")).select(F.col("parts.host").alias("domain"), "parts.robots_url", "parts.path")
    fetches = spark.createDataFrame([("http://ex.org/robots.txt", 200, bytearray(b"User-agent: *\nDisallow: /a"))], "robots_url string, code int, body binary")
    first = it.check_robots(requests, fetches, now).first()
    assert (first.allowed, first.source) == (False, "fresh")
    second = it.check_robots(requests, fetches.limit(0), now).first()
    assert (second.allowed, second.source) == (False, "cached")
    later = it.check_robots(requests, fetches.limit(0), now + F.expr("interval 2 days")).first()
    assert later.reason.endswith("(stale cache)") and it.table("robots_cache").count() == 1
    assert it.extract(spark.createDataFrame([(1, "<p>x</p>")], "page_id int, html string")).first().error_type == "no_recipe_found"
    assert fields.NOT_FOUND and it.list().count() == 0
