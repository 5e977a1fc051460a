import json
import re

import pytest
from pyspark.sql import functions as F

from tabquest.operators import lookups
from tabquest.plans import profile
from tabquest.plans.refresh import refresh_assets
from tabquest.session import small_table, work_dir
from tabquest.sources import manifest as manifests
from tabquest.sources import metadata as metadata_source
from tabquest.sources import tables, vector_store

ENTRIES = [
    {"file_path": "a.csv", "dataset_name": " First Set ", "table_name": "T 1", "metadata_path": "m/a.json"},
    {"file_path": "b.csv", "dataset_name": "first set", "metadata_path": "m/b.json", "description": " About b "},
    {"file_path": "", "dataset_name": "Broken"},
    {"file_path": " a.csv ", "dataset_name": "Again", "metadata_path": "m/c.json"},
]


@pytest.fixture()
def manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(ENTRIES, indent=2))
    return manifests.read_manifest(spark, str(path))


def test_manifest_keeps_order_and_optional_fields(manifest):
    rows = manifest.orderBy("entry_pos").collect()
    assert [r["entry_pos"] for r in rows] == [0, 1, 2, 3]
    assert rows[0]["table_name"] == "T 1" and rows[1]["table_name"] is None


@pytest.mark.parametrize("content", ['{"file_path": "a.csv"}', '"x"'])
def test_manifest_must_be_an_array(spark, tmp_path, content):
    path = tmp_path / "manifest.json"
    path.write_text(content)
    with pytest.raises(Exception, match="Manifest must be a JSON array"):
        manifests.read_manifest(spark, str(path)).collect()


def test_filter_and_validate(manifest):
    assert manifests.filter_manifest(manifest, []).count() == 4
    assert manifests.filter_manifest(manifest, ["FIRST set "]).count() == 2
    valid, rejected = manifests.split_valid(manifest, ["file_path", "metadata_path"])
    assert valid.count() == 3
    assert [r["missing_field"] for r in rejected.collect()] == ["file_path"]
    with pytest.raises(Exception, match="missing required field: file_path"):
        manifests.require_fields(manifest, ["file_path"]).collect()


def test_first_entry_wins(spark, manifest):
    found = spark.createDataFrame([("a.csv ",), ("zzz",)], "file_path string")
    joined = lookups.find_entries(found, manifest)
    names = {r["file_path"]: r["entry"] and r["entry"]["dataset_name"] for r in joined.collect()}
    assert names == {"a.csv ": " First Set ", "zzz": None}


def test_table_resolution(spark, manifest):
    asked = spark.createDataFrame(
        [(1, "Given T", "x"), (2, None, "FIRST SET"), (3, "", "again"), (4, None, "nope"), (5, None, None)],
        "i int, table_name string, dataset_name string",
    )
    found = {r["i"]: r["resolved_table"] for r in lookups.resolve_table_names(asked, manifest).collect()}
    assert found == {1: "Given T", 2: "t_1", 3: "again", 4: None, 5: None}
    with pytest.raises(Exception, match="Dataset not found in manifest: nope"):
        lookups.resolve_table_names(asked.filter("i = 4"), manifest, strict=True).collect()


def test_descriptions_prefer_metadata(spark, manifest):
    known = small_table(spark, [("m/a.json", " from file ", ""), ("m/b.json", " ", "noted")],
                        "metadata_path string, description string, data_interpretation_notes string")
    found = lookups.described(lookups.find_entries(spark.createDataFrame([("a.csv",), ("b.csv",)], "file_path string"), manifest), known)
    assert {(r["file_path"], r["description"], r["notes"]) for r in found.collect()} == {
        ("a.csv", "from file", ""), ("b.csv", "About b", "noted"),
    }


def test_csv_import_skips_and_replaces(spark, tmp_path):
    source = tmp_path / "d.csv"
    source.write_text('id,Drug 1,price_usd,expiry\n1,"a ""b"", c",2.5,2024-01-02\n2,,,\n')
    name, place = "imported_drugs", work_dir(spark, "t")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert tables.import_csv(spark, str(source), name, location=place).startswith("Imported")
    rows = spark.table(name).orderBy("id").collect()
    assert rows[0]["Drug 1"] == 'a "b", c' and rows[0]["price_usd"] == 2.5 and str(rows[0]["expiry"]) == "2024-01-02"
    assert rows[1]["Drug 1"] is None and rows[1]["price_usd"] is None
    source.write_text("id\n7\n")
    assert tables.import_csv(spark, str(source), name, location=place).startswith("Skipping")
    assert spark.table(name).count() == 2
    tables.import_csv(spark, str(source), name, force=True, schema="id long", location=place)
    assert [tuple(r) for r in spark.table(name).collect()] == [(7,)]
    columns = tables.table_columns(tables.session_catalog(spark).filter(F.col("table_name") == name), name)
    assert columns == [{"name": "id", "type": "bigint"}]
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(ValueError, match="Table not found"):
        tables.table_columns(tables.session_catalog(spark), name)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.import_csv(spark, str(tmp_path / "none.csv"), name)


def test_metadata_files_with_bare_nan(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "x.json").write_text(
        '{\n "dataset_name": "X", "num_rows": 2, "columns": ["a"],\n "sample_rows": [{"a": NaN, "b": 1}, {"a": "NaN x"}]}'
    )
    row = metadata_source.read_metadata(spark, str(tmp_path), "metadata/*.json").first()
    assert row["metadata_path"] == "metadata/x.json"
    assert row["sample_rows"] == [{"a": None, "b": "1"}, {"a": "NaN x"}]


def test_profile_counts_samples_and_defaults(spark, manifest):
    data = spark.createDataFrame([(i, None if i == 1 else f"n{i}") for i in range(5)], "k int, name string")
    entries = manifests.split_valid(manifest, ["metadata_path"])[0].filter("entry_pos = 1")
    row = profile.build_metadata(entries, {"b.csv": data}, 2, {"b.csv": ["k"]}).first()
    assert (row["num_rows"], row["num_columns"], row["columns"]) == (5, 2, ["k", "name"])
    assert row["sample_rows"] == [{"k": "0", "name": "n0"}, {"k": "1", "name": None}]
    assert row["description"] == "About b It contains 5 rows and 2 columns in CSV format."


def test_upsert_replaces_by_key_and_keeps_the_rest(spark):
    path = work_dir(spark, "store")
    schema = "record_id string, document string, place int"
    assert vector_store.read_store(spark, path) is None
    first = spark.createDataFrame([("a", "1", 0), ("b", "1", 0), ("c", "1", 0)], schema)
    vector_store.upsert(spark, path, first, "record_id", F.col("place"), buckets=4)
    second = spark.createDataFrame([("b", "2", 0), ("b", "3", 1), ("d", "2", 0)], schema)
    vector_store.upsert(spark, path, second, "record_id", F.col("place"), buckets=4)
    store = vector_store.read_store(spark, path)
    assert {(r["record_id"], r["document"]) for r in store.collect()} == {("a", "1"), ("b", "3"), ("c", "1"), ("d", "2")}
    assert {r["record_id"] for r in vector_store.new_records(second, store, "record_id").collect()} == set()
    assert vector_store.new_records(second, store, "record_id", force=True).count() == 3
    ids = spark.createDataFrame([("a",), ("a",), ("q",)], "record_id string")
    assert [r["record_id"] for r in vector_store.get_records(store, ids, "record_id").collect()] == ["a"]


def test_empty_batch_leaves_an_empty_store(spark):
    path = work_dir(spark, "store")
    schema = "record_id string, document string, place int"
    vector_store.upsert(spark, path, spark.createDataFrame([], schema), "record_id", F.col("place"))
    assert vector_store.read_store(spark, path) is None
    vector_store.upsert(spark, path, spark.createDataFrame([("a", "1", 0)], schema), "record_id", F.col("place"))
    assert vector_store.read_store(spark, path).count() == 1


def test_lookup_reads_only_the_buckets_it_needs(spark):
    path = work_dir(spark, "store")
    rows = spark.range(200).selectExpr("id AS record_id", "'old' AS document", "0 AS place")
    vector_store.upsert(spark, path, rows, "record_id", F.col("place"), buckets=50)
    vector_store.upsert(spark, path, rows.filter("record_id < 10").withColumn("document", F.lit("new")), "record_id", F.col("place"))
    found = vector_store.lookup(spark, path, spark.createDataFrame([(3,), (11,), (999,)], "record_id long"))
    assert {(r["record_id"], r["document"]) for r in found.collect()} == {(3, "new"), (11, "old")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    vector_store.compact(spark, path)
    assert len(vector_store.commits(spark, path)) == 1
    store = vector_store.read_store(spark, path)
    assert store.count() == 200 and store.filter("document = 'new'").count() == 10


def test_what_was_not_committed_is_not_read(spark, monkeypatch):
    path = work_dir(spark, "store")
    rows = spark.range(5).selectExpr("id AS record_id", "'old' AS document", "0 AS place")
    vector_store.upsert(spark, path, rows, "record_id", F.col("place"))
    newer = rows.withColumn("document", F.lit("new"))
    with monkeypatch.context() as broken:
        broken.setattr(vector_store, "small_table", lambda *_: 1 / 0)  # dies between the records and their commit
        with pytest.raises(ZeroDivisionError):
            vector_store.upsert(spark, path, newer, "record_id", F.col("place"))
    assert {r["document"] for r in vector_store.read_store(spark, path).collect()} == {"old"}
    vector_store.upsert(spark, path, newer.filter("record_id = 1"), "record_id", F.col("place"))
    assert vector_store.read_store(spark, path).filter("document = 'new'").count() == 1


def test_work_folder_is_the_clusters():
    class Session:
        def __init__(self, settings, master):
            self.conf, self.sparkContext = settings, type("Context", (), {"master": master})

    assert work_dir(Session({"spark.checkpoint.dir": "hdfs:/shared/"}, "yarn"), "x").startswith("hdfs:/shared/x-")
    assert work_dir(Session({}, "local[4]"), "x").startswith("/tmp/run-")
    with pytest.raises(RuntimeError, match="shared folder"):
        work_dir(Session({}, "yarn"), "x")


def test_refresh_builds_each_asset_once(spark, tmp_path):
    entries = []
    for name in ("survey", "labels"):
        (tmp_path / f"{name}.csv").write_text("id,treatment\n1,yes\n2,no\n")
        entries.append({"file_path": f"{tmp_path}/{name}.csv", "metadata_path": f"m/{name}.json", "dataset_name": f"Refresh {name}"})
    (tmp_path / "manifest.json").write_text(json.dumps(entries))
    folders = {k: work_dir(spark, k) for k in ("metadata_folder", "store_path", "table_location")}
    run = lambda **more: refresh_assets(spark, str(tmp_path / "manifest.json"), **folders, **more)
    try:
        assert run(dataset_names=["refresh SURVEY"]) == [
            "Generated metadata: 1", "Embeddings are up to date", "Imported dataset into table: refresh_survey",
        ]
        assert run()[0] == "Generated metadata: 1"
        assert run()[0] == "Generated metadata: 0"
        assert run(force=True, skip_tables=True, skip_embeddings=True) == ["Generated metadata: 2"]
        assert run(dataset_names=["none"]) == ["No matching datasets found in the manifest."]
        store = vector_store.read_store(spark, folders["store_path"])
        assert {r["record_id"] for r in store.collect()} == {"survey", "labels"}
        stored = metadata_source.read_written_metadata(spark, folders["metadata_folder"])
        assert {(r["dataset_name"], r["num_rows"]) for r in stored.collect()} == {("Refresh survey", 2), ("Refresh labels", 2)}
        assert spark.table("refresh_labels").count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS refresh_survey")
        spark.sql("DROP TABLE IF EXISTS refresh_labels")


def test_line_breaks_inside_quotes(spark, tmp_path):
    lines = "".join(f'{i},"first {i}\nsecond ""{i}"""\n' for i in range(10))
    (tmp_path / "notes.csv").write_text("id,note\n" + lines)
    path, name = str(tmp_path / "notes.csv"), f"notes_{tmp_path.name.replace('-', '_')}"
    rows = tables.read_csv(spark, path).orderBy("id").collect()
    assert len(rows) == 10 and rows[3]["note"] == 'first 3\nsecond "3"'
    tables.import_csv(spark, path, name, location=str(tmp_path / "table"))
    assert spark.table(name).count() == 10
    spark.sql(f"DROP TABLE {name}")
    with pytest.raises(Exception):  # noqa: B017  a line is not a whole record
        tables.read_csv(spark, path, "id int, note string", multiline=False).collect()
