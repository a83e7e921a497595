"""Saves, patches, deletions, reads, search, merge and versions on small tables."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quernstone.operators import fields, store, versions
from quernstone.sources import interchange
from quernstone.streaming import sync

NOW = "2024-01-02T00:00:00.000000Z"


@pytest.fixture(scope="module")
def empty(spark):
    tables, found = versions.migrated(spark, {}, spark.createDataFrame([], versions.VERSIONS), F.lit(NOW))
    again, same = versions.migrated(spark, tables, found, F.lit("later"))
    assert [r.version for r in found.orderBy("version").collect()] == [1, 2] and same.count() == 2 and again.keys() == tables.keys()
    return store.Store(*(tables[n] for n in ("recipes", "ingredients", "instructions", "tags", "change_log")))


def saves(spark, *rows):
    """Saves (url, seq, title, parts, cuisine tags)."""
    base = spark.createDataFrame(list(rows), "source_url string, seq int, t string, parts array<string>, labels array<struct<label:string,confidence:double>>")
    none = F.array().cast(f"array<{store.TAG}>")
    return base.select(
        "source_url", "seq", fields.field(F.col("t")).alias("title"), *(fields.field(F.lit(None).cast(kind)).alias(n) for n, _, kind in store.FIELDS[1:]), F.lit("json_ld").alias("source"),
        F.transform("parts", lambda p: F.struct(p.alias("name"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("string").alias("unit"), p.alias("raw_text"))).alias("ingredients"),
        F.array(F.struct(F.lit(1).alias("step_number"), F.lit("stir").alias("text"))).alias("instructions"), F.struct(F.col("labels").alias("cuisine"), none.alias("course"), none.alias("diet")).alias("tags"),
    )


@pytest.fixture(scope="module")
def filled(spark, empty):
    rows = [("u1", 1, "Soup", ["Salt 100%", "JALAPEÑO"], [("Thai", 0.6), ("Thai", 0.9)]), ("u2", 2, None, ["a_b"], [("Thai", 0.7), ("Lao", 0.8)]), ("u1", 3, "Soup two", ["Rice"], [("Thai", 0.5)])]
    return store.saved(empty, saves(spark, *rows), F.lit(NOW), "me")


def test_same_url_updates_instead_of_duplicating(filled):
    after, results = filled
    assert sorted((r.source_url, r.seq, r.created, r.error) for r in results.collect()) == [("u1", 1, True, None), ("u1", 3, False, None), ("u2", 2, True, None)]
    found = {r.source_url: r for r in store.assembled(after).collect()}
    assert found["u1"].title.value == "Soup two" and [i.name for i in found["u1"].ingredients] == ["Rice"] and found["u1"].notes == ""
    assert found["u2"].title == ("not_found", None, "Not found in source") and [t.label for t in found["u2"].tags.cuisine] == ["Lao", "Thai"]
    log = after.change_log.collect()
    assert sorted(r.field_name for r in log) == sorted(["title", "title"] + ["ingredients", "instructions", "tags"] * 3)
    assert len({r.id for r in log}) == len(log) and min(r.id for r in log) > 0


def test_list_is_of_active_records_newest_first(spark, filled):
    after, _ = filled
    ids = {r.source_url: r.id for r in after.recipes.collect()}
    later, _ = store.updated(after, spark.createDataFrame([(ids["u2"], "n")], "id string, notes string"), F.lit("2025"), "me")
    assert [r.source_url for r in store.listed(later).collect()] == ["u2", "u1"]
    gone, results = store.soft_deleted(later, spark.createDataFrame([(ids["u2"],), ("x",)], "id string"), F.lit("2026"), "me")
    assert sorted(tuple(r) for r in results.collect()) == sorted([(ids["u2"], True), ("x", False)])
    assert [r.source_url for r in store.listed(gone).collect()] == ["u1"]
    missing = store.looked_up(gone, spark.createDataFrame([(ids["u2"],), (ids["u1"],)], "id string")).collect()
    assert {r.id: r.error for r in missing} == {ids["u1"]: None, ids["u2"]: f"Recipe not found: {ids['u2']}"}
    again, results = store.saved(gone, saves(spark, ("u2", 9, "t", [], [])), F.lit("2027"), "me")
    assert "UNIQUE" in results.first().error and again.recipes.where("deleted = 1").count() == 1
    assert [r.field_value for r in gone.change_log.where("field_name = '__deleted'").collect()] == ["true"]


def test_patches_set_fields_found_and_log_them(spark, filled):
    after, _ = filled
    ids = {r.source_url: r.id for r in after.recipes.collect()}
    patches = spark.createDataFrame([(ids["u2"], "New", 5, [("egg", 2.0, "pc", "2 eggs")]), ("x", "t", 1, None)], f"id string, title string, prep_time_minutes int, ingredients array<{store.INGREDIENT}>")
    later, results = store.updated(after, patches, F.lit("2025"), "other")
    assert {r.id: (r.updated_at, r.error) for r in results.collect()} == {ids["u2"]: ("2025", None), "x": (None, "Recipe not found: x")}
    row = next(r for r in store.assembled(later).collect() if r.id == ids["u2"])
    assert row.title == ("found", "New", None) and row.prep_time_minutes.value == 5 and [tuple(i) for i in row.ingredients] == [("egg", 2.0, "pc", "2 eggs")]
    new = later.change_log.where("device_id = 'other'").orderBy("id").collect()
    assert [r.field_name for r in new] == ["title", "prep_time_minutes", "ingredients"] and min(r.id for r in new) > max(r.id for r in after.change_log.collect())


def test_search_folds_ascii_only_and_takes_wildcards(filled):
    after, _ = filled
    found = lambda text=None, **tags: sorted(r.source_url for r in store.search(after, text, **tags).collect())
    assert found("SOUP") == ["u1"] and found("a_B") == ["u2"] and found("r%e") == ["u1"] and found("\\") == [] and found(" ") == ["u1"]
    assert found("") == found() == ["u1", "u2"]  # an empty text keeps records without a title
    assert found(cuisine=["Thai"]) == ["u1", "u2"] and found(cuisine=["Thai", "Lao"]) == ["u2"] and found(cuisine=["thai"]) == [] and found(diet=["Thai"]) == [] and found("soup", cuisine=["Lao"]) == []


def test_ascii_fold_leaves_other_letters(spark, empty):
    after, _ = store.saved(empty, saves(spark, ("u", 1, "JALAPEÑO 5$ (x)", [], [])), F.lit(NOW), "me")
    hits = lambda text: store.search(after, text).count()
    assert [hits(t) for t in ("jalapeÑo", "jalapeño", "5$ (X)", "5. ")] == [1, 0, 1, 0]


def test_orphans_go(spark, filled):
    after, _ = filled
    lone = after.tags.unionByName(spark.createDataFrame([("nobody", "diet", "x", 1.0)], store.TAGS))
    whole = store.without_orphans(store.Store(after.recipes, after.ingredients, after.instructions, lone, after.change_log))
    assert sorted(map(tuple, whole.tags.collect())) == sorted(map(tuple, after.tags.collect()))


RECORDS = "id string, title string, title_status string, description string, description_status string, notes string, servings string, prep_time_minutes bigint, cook_time_minutes bigint, deleted int, updated_at string"
LOG = "record string, field string, value string, at string, device string"


def merged(spark, log, deleted=0):
    rows = spark.createDataFrame([("r", "old", "not_found", "d", "found", "n", "4", 1, 2, deleted, "then")], RECORDS)
    return sync.merged(rows, spark.createDataFrame(log, LOG), F.lit("now"), "me").first()


def test_merge_picks_newer_and_counts_met_records(spark):
    r = merged(spark, [("r", "title", "a", "1", "me"), ("r", "title", "b", "2", "x"), ("r", "cook_time_minutes", "9", "1", "me"), ("other", "title", "z", "9", "x")])
    assert (r.title, r.title_status, r.cook_time_minutes, r.servings, r.updated_at, r.merged) == ("b", "found", 9, "4", "now", True)
    assert merged(spark, [("r", "title", "a", "1", "x"), ("r", "title", "b", "1", "y")]).title == "b"  # ties by device


def test_merge_of_own_rows_alone_changes_nothing(spark):
    r = merged(spark, [("r", "title", "a", "1", "me")])
    assert (r.title, r.updated_at, r.merged) == ("old", "then", False)


def test_merge_takes_null_values(spark):
    r = merged(spark, [("r", "notes", None, "1", "x"), ("r", "title", None, "1", "x"), ("r", "tags", "[]", "1", "x")])
    assert (r.notes, r.title, r.title_status, r.description) == ("", None, "found", "d")


def test_delete_against_modify(spark):
    r = merged(spark, [("r", "__deleted", "true", "2", "x"), ("r", "title", "a", "2", "me")])
    assert (r.deleted, r.title, r.updated_at, r.merged) == (1, "old", "then", True)  # a tie deletes
    r = merged(spark, [("r", "__deleted", "true", "2", "x"), ("r", "title", "a", "3", "me")], deleted=1)
    assert (r.deleted, r.title, r.updated_at) == (0, "a", "now")
    r = merged(spark, [("r", "__deleted", "true", "2", "x"), ("r", "tags", "[]", "3", "x")], deleted=1)
    assert (r.deleted, r.updated_at) == (0, "then")


def test_log_goes_round_once(spark, tmp_path):
    log = spark.createDataFrame([(1, "r", "title", "a", "1", "b", 0), (2, "r", "notes", None, "1", "b", 0), (3, "r", "x", "y", "1", "b", 1)], store.CHANGE_LOG)
    folder = str(tmp_path / "s")
    after, n = sync.exported(log, folder, "b")
    assert n == 2 and after.where("synced = 0").count() == 0
    assert sync.exported(after, folder, "b")[1] == 0
    sync.exported(log, folder, "b")  # as after a failure
    assert sorted((r.id, r.field_value, r.file_device) for r in sync.lines(spark, folder, "c").collect()) == [(1, "a", "b"), (2, None, "b")]
    assert sync.lines(spark, folder, "b").count() == 0 and sync.lines(spark, str(tmp_path / "none"), "b").count() == 0


def test_streamed_log_goes_on(spark, tmp_path):
    schema = "record string, field string, value string, at int, device string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: {(r.record, r.field): r.value for r in sync.latest_stream(spark.newSession().readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out")).collect()}
    put(("r", "t", "a", 1, "x"))
    put(("r", "t", "b", 3, "x"), ("r", "n", None, 1, "x"))
    assert run() == {("r", "t"): "b", ("r", "n"): None}
    put(("r", "t", "late", 2, "x"), ("q", "t", "z", 1, "x"))
    assert run() == run() == {("r", "t"): "b", ("r", "n"): None, ("q", "t"): "z"}


def test_rules_are_fetched_once_within_their_time(spark, tmp_path):
    schema = "domain string, at timestamp"
    put = lambda *rows: spark.createDataFrame(list(rows), "domain string, at string").select("domain", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        query = sync.to_fetch(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.domain, str(r.at)[:10]) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    put(("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 01:00:00"))
    assert [d for d, _ in run()] == ["a", "b"]
    put(("a", "2024-01-01 20:00:00"), ("c", "2024-01-09 00:00:00"))
    assert [d for d, _ in run()] == ["a", "b", "c"]
    put(("a", "2024-01-10 00:00:00"))
    assert run()[-3:] == [("a", "2024-01-10"), ("b", "2024-01-01"), ("c", "2024-01-09")]


def test_import_outcome_and_errors(spark, empty, tmp_path):
    good = {"@context": "c", "@type": "Recipe", "name": "n", "recipeIngredient": ["a"], "recipeInstructions": [], "url": "u"}
    (tmp_path / "f.json").write_text(json.dumps([good, {"name": "no"}, good]))
    rows = interchange.imported_file(spark, str(tmp_path / "f.json"))
    assert [(r.at, r.error is None) for r in rows.orderBy("at").collect()] == [(0, True), (1, False), (2, True)]
    _, results = store.saved(empty, interchange.as_saves(rows.where("error is null")), F.lit(NOW), "me")
    bad = rows.where("error is not null").select(F.col("url").alias("source_url"), F.col("at").alias("seq"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("boolean").alias("created"), "error")
    row = store.outcome(results.unionByName(bad)).first()
    assert (row.imported, row.updated, row.skipped, len(row.errors)) == (1, 1, 1, 1) and row.errors[0].startswith("Item 1: missing @context")
    (tmp_path / "g.json").write_text("{}")
    with pytest.raises(Exception, match="Failed to parse JSON"):
        interchange.array_items(spark, str(tmp_path / "g.json")).collect()


def test_snapshot_needs_records(spark, filled, tmp_path):
    after, _ = filled
    said = interchange.backed_up({"recipes": after.recipes, "tags": after.tags}, str(tmp_path / "b"))
    assert said["recipe_count"] == 2 and said["file_size_bytes"] > 0
    tables, active = interchange.restored(spark, str(tmp_path / "b"), ["recipes", "tags"])
    assert active == 2 and tables["tags"].count() == after.tags.count()
    with pytest.raises(ValueError, match="no recipes table"):
        interchange.restored(spark, str(tmp_path), ["recipes"])


def test_array_files_are_cut_into_elements_by_their_bytes(spark, tmp_path):
    """Many byte ranges and chunks in one file of one line; commas, brackets and quotes within strings; no row holds the file."""
    from quernstone.sources import json_arrays

    odd = ['a,b', '"', "\\", '\\",[', "]}", "é,ü" * 9, "", "\n"]
    values = [{"k": i, "s": odd[i % 8] * (i % 40), "l": [i, [odd[(i + 3) % 8]]]} if i % 5 else [i, odd[i % 8]][i % 2] for i in range(200)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for name, text in (("one", json.dumps(values, ensure_ascii=False)), ("lines", json.dumps(values, indent=1)), ("none", " [ \n ] "), ("single", "[[]]\n")):
        (tmp_path / f"{name}.json").write_text(text)
        try:
            for k in old:
                spark.conf.set(k, "1997")
            found = interchange.array_items(spark, str(tmp_path / f"{name}.json")).orderBy("at").collect()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        want = json.loads(text)
        assert [r.at for r in found] == list(range(len(want))) and [json.loads(r.json) for r in found] == want
    rows = json_arrays.elements(spark, str(tmp_path / "one.json"))
    assert rows.agg(F.max(F.length("text"))).first()[0] < 3000


def test_chunks_of_a_block_give_the_same_elements(monkeypatch):
    import pyarrow as pa

    from quernstone.sources import json_arrays

    values = [{"s": ['a,b"', '\\\\",[', "é]}"][i % 3] * i, "l": [i, {}]} for i in range(30)]
    text = json.dumps(values, ensure_ascii=False)
    pieces = [p.encode() for p in text.split(",")]
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * len(p)), pa.array([0] * len(p)), pa.array([len(text.encode())] * len(p)), pa.array(p)], ["file", "block", "size", "value"]) for p in (pieces[:9], pieces[9:])]
    monkeypatch.setattr(json_arrays, "CHUNK", 5)
    fields = ["file", "block", "n", "size", "text", "blank", "turns", "rises", "commas"]
    chunks = [SimpleNamespace(**dict(zip(fields, (c[0].as_py() for c in b.columns), strict=True)), bytes=len(b.column(4)[0].as_py())) for b in json_arrays._chunked(batches)]
    states, found = json_arrays._states(chunks), {}
    for c in chunks:
        within, depth, opened, at, _ = states[c.file, c.block, c.n]
        for k, part in enumerate(json_arrays._parts(c.text, within, depth, opened)):
            found[at + k] = found.get(at + k, b"") + part
    assert len(chunks) > 100 and [json.loads(found[k]) for k in range(len(found))] == values


def test_chunks_are_cut_anywhere_but_within_escapes_and_characters():
    from quernstone.sources import json_arrays

    text = bytearray('["é\\\\\\"x"]'.encode())
    for size in range(1, len(text)):
        end = json_arrays._end(text, size)
        assert text[:end].decode() and (len(text[:end]) - len(bytes(text[:end]).rstrip(b"\\"))) % 2 == 0


@pytest.mark.parametrize("text", ["{}", "[1,2", "[1,2]]", "[1,2] 3", "[1,,2]", "[1,2,]", "[1,2],", "[1 2]", "[1}", "[1},2]", '["a]', "1", "[1][2]", "[1],[2]", " ", '[{"a":1] , {"b":2}]', ',[1]'])
def test_files_that_are_no_array_are_errors(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception, match="Failed to parse JSON"):
        interchange.array_items(spark, str(tmp_path / "f.json")).collect()
