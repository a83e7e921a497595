"""Change-log files, watermarks, marks, status and snapshots on small tables."""

import json

from quernstone.sources import interchange
from quernstone.streaming import sync


def test_lines_watermarks_and_status(spark, tmp_path):
    row = {"id": 1, "recipe_id": "r", "field_name": "title", "field_value": None, "modified_at": "t", "device_id": "b"}
    lacking = {k: v for k, v in row.items() if k != "field_name"}
    (tmp_path / "changes-b.jsonl").write_text("\n".join([json.dumps(row), "", "bad", json.dumps(lacking), json.dumps(row | {"id": 5})]))
    (tmp_path / "changes-own.jsonl").write_text(json.dumps(row))
    rows = sync.lines(spark, str(tmp_path), "own")
    assert sorted(r.id for r in rows.collect()) == [1, 5]
    state = spark.createDataFrame([("b", 1, "2024")], "device string, last_id bigint, last_sync_at string")
    assert [r.id for r in sync.not_imported(rows, state).collect()] == [5]
    assert [tuple(r) for r in sync.watermarks(rows, state).collect()] == [("b", 5)]
    log = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, synced int")
    assert [r.id for r in sync.pending(sync.marked(log, 1)).collect()] == [2]
    found = sync.status(log, state).first()
    assert (found.pending, found.devices, found.last_sync_at) == (2, ["b"], "2024")


def test_snapshot_is_restored(spark, tmp_path):
    interchange.backed_up({"recipes": spark.range(3).toDF("id")}, str(tmp_path / "b"))
    assert interchange.restored(spark, str(tmp_path / "b"), ["recipes"])[1] == 3


def test_interchange_keeps_all_properties(spark):
    one = "named_struct('label', 'x–y', 'confidence', 0.5D)"
    none = "cast(array() as array<struct<label:string,confidence:double>>)"
    rows = spark.sql(f"""SELECT 1 AS id, 'Soup' AS title, 'd' AS description, array('2 cups salt') AS ingredients, array(named_struct('step_number', 1, 'text', 'stir')) AS instructions,
        5 AS prep, cast(null AS int) AS cook, '4' AS servings, 'http://x' AS url, array('i') AS images,
        named_struct('calories', 250L, 'fat_grams', 12D, 'saturated_fat_grams', 1.25D, 'carbs_grams', 12345678.5D, 'fiber_grams', 0.00012D, 'sugar_grams', 1e22D, 'protein_grams', cast(null AS double), 'sodium_mg', 4000000000L) AS nutrition,
        'ai_fallback' AS source, named_struct('cuisine', array({one}), 'course', {none}, 'diet', array({one}, {one})) AS tags, 'own' AS notes,
        array(named_struct('name', 'salt', 'quantity', 2D, 'unit', 'cups', 'raw_text', '2 cups salt')) AS ingredients_parsed""")
    out = interchange.exported(rows)
    json_ = json.loads(out.first().json)
    assert json_["nutrition"] == {"@type": "NutritionInformation", "calories": "250 calories", "fatContent": "12 g", "saturatedFatContent": "1.25 g", "carbohydrateContent": "12345678.5 g", "fiberContent": "0.00012 g", "sugarContent": "10000000000000000000000 g", "sodiumContent": "4000000000 mg"}
    assert json_["x-ingredientsParsed"] == [{"name": "salt", "quantity": 2.0, "unit": "cups", "rawText": "2 cups salt"}] and json_["x-tags"]["course"] == []
    names = [n for n in rows.columns if n != "id"]
    back = interchange.imported(out)
    assert back.select(names).first().asDict(True) == rows.select(names).first().asDict(True) and back.first().error is None


def test_interchange_takes_and_reports_odd_properties(spark):
    base = {"@context": "c", "@type": "Recipe", "recipeIngredient": ["a"], "recipeInstructions": []}
    tags = {"cuisine": [{"label": "l", "confidence": 7}], "course": [], "diet": []}
    odd = [
        {"nutrition": {"@type": "N", "calories": " 90 kcal", "fatContent": "1.5f g", "fiberContent": ".5", "sodiumContent": "-1 mg"}, "x-extractionSource": "?", "x-tags": tags},
        {},
        {"nutrition": "much"},
        {"nutrition": {"calories": "1"}},
        {"x-tags": {"cuisine": []}},
        {"x-ingredientsParsed": [{"name": "n"}]},
    ]
    found = interchange.imported(spark.createDataFrame([(i, json.dumps(base | x)) for i, x in enumerate(odd)], "id int, json string").coalesce(1)).collect()
    facts = found[0].nutrition
    assert (facts.calories, facts.fat_grams, facts.fiber_grams, facts.sodium_mg) == (90, None, 0.5, None)
    assert found[0].source == "json_ld" and found[0].tags.cuisine[0].confidence == 1
    assert found[1].nutrition is None and found[1].tags.diet == [] and [tuple(i) for i in found[1].ingredients_parsed] == [("a", None, None, "a")]
    assert [r.error for r in found] == [None, None, "unreadable nutrition", "nutrition without type", "incomplete course tags, incomplete diet tags", "incomplete parsed ingredient"]
