import json
import os

import pytest
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens import schemas
from hazardlens.session import new_folder, note_table, path_exists, scratch_scope, shared_root
from hazardlens.sources import csv_files, documents, tables
from hazardlens.sources.tables import append_new, bucketed_table, missing_rows, written
from tests.conftest import rows


def test_csv_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('package_name,description\nx,"a, ""b""\nc"\n\ny,\n"z",""\n')
    found = rows(csv_files.read_cells(spark, str(tmp_path), ["package_name", "description"]))
    assert found == [("x", 'a, "b"\nc'), ("y", None), ("z", None)]


def test_csv_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Package_Name ,STARS\nx,1\n")
    assert rows(csv_files.read_by_header(spark, str(tmp_path)), "stars", "package_name") == [("1", "x")]


def test_csv_round_trip(spark):
    cells = [("q\"uote", "com,ma"), ("line\nbreak", None), (" edge ", "x")]
    folder = new_folder(spark, "t")
    csv_files.write_cells(spark.createDataFrame(cells, "a string, b string"), folder, ["b", "a"])
    assert rows(csv_files.read_cells(spark, folder, ["b", "a"]), "a", "b") == sorted(cells, key=repr)


def test_typed_cells(spark, tmp_path):
    header = ",".join(fixed.RISK_COLUMNS)
    (tmp_path / "a.csv").write_text(header + "\nx,npm,5,,bad,,,,Active,2020-01-02T03:04:05Z,,,true,false,1,0,9.5,False\n")
    row = csv_files.read_typed(spark, str(tmp_path), schemas.RISK_SUMMARY).first()
    assert (row["stars"], row["forks"], row["contributions_count"]) == (5, None, None)
    assert (row["has_repository"], row["has_high_severity_vulnerability"]) == (True, False)
    assert row["latest_release_published_at"].isoformat() == "2020-01-02T03:04:05" and row["max_severity_score"] == 9.5


def test_document_folder(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"id": "A", "affected": []}, indent=2))
    (tmp_path / "bad.json").write_text('{"id": ')
    (tmp_path / "note.txt").write_text('{"id": "B"}')
    found = documents.read_folder(spark, str(tmp_path), schemas.VULNERABILITY_DOCUMENT)
    assert [row["id"] for row in documents.readable(found).collect()] == ["A"]
    assert len(documents.unreadable(found).collect()) == 1


def test_csv_to_json(spark):
    cells, lines = new_folder(spark, "t"), new_folder(spark, "t")
    csv_files.write_cells(spark.createDataFrame([("a", 1), ("b", None)], "n string, x long"), cells, ["n", "x"])
    csv_files.csv_to_json(spark, cells, lines)
    assert rows(spark.read.schema("n string, x string").json(lines)) == [("a", "1"), ("b", None)]


def test_replace_append_and_optional(spark):
    folder = new_folder(spark, "t")
    assert not path_exists(spark, folder)
    assert tables.read_or_empty(spark, folder, schemas.PACKAGE_NAMES).count() == 0
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    tables.append_new(frame, folder, ["k"])
    tables.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v long"), folder, ["k"])
    assert rows(spark.read.parquet(folder)) == [("a", 1), ("b", 2), ("c", 3)]
    tables.replace_table(frame, folder, ["v"])
    assert rows(spark.read.parquet(folder)) == [(1,), (2,)]
    assert tables.read_first_existing(spark, [new_folder(spark, "none"), folder]).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_first_existing(spark, [new_folder(spark, "none")])


def test_defaults_and_contract(spark):
    frame = spark.createDataFrame([("a", None), ("a", 2), (None, 3)], "package_name string, stars long")
    assert rows(tables.with_defaults(frame, {"stars": 0}), "stars") == [(0,), (2,), (3,)]
    assert rows(tables.contract_breaches(frame, ["package_name"], ["package_name"])) == [
        ("not null: package_name", 1), ("unique: package_name", 1)]


def test_sorted_output_stays_sorted(spark):
    folder = new_folder(spark, "t")
    frame = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    csv_files.write_cells(frame.orderBy(F.col("x").desc()), folder, ["x"])
    parts = (spark.read.option("header", "true").schema("x int").csv(folder)
             .select("x", F.input_file_name().alias("file")).groupBy("file").agg(F.min("x"), F.max("x")).orderBy("file").collect())
    assert all(after[2] < before[1] for before, after in zip(parts, parts[1:]))


def test_scratch_folder_is_the_configured_one(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert shared_root(spark).startswith(root)
    assert new_folder(spark, "a") != new_folder(spark, "a")


def test_append_never_shuffles_the_table(spark, tmp_path):
    path = f"{tmp_path}/table"
    first = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("value"))
    append_new(first, path, ["key"], buckets=8)
    more = spark.range(2990, 3010).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(-1).cast("long").alias("value"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        name = bucketed_table(spark, path, first.schema, ["key"], 8)
        missing = missing_rows(more, spark.table(name), ["key"], 8)
        assert missing.count() == 10
        plan = missing._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the new rows alone are dealt
        spark.sql(f"DROP TABLE {name}")
        append_new(more, path, ["key"])
        append_new(more, path, ["key"])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    found = spark.read.parquet(path)
    assert found.count() == 3010 and found.where("value = -1").count() == 10
    assert not spark.catalog.listTables()
    with pytest.raises(ValueError, match="bucketed by"):
        append_new(more, path, ["value"])


def test_append_to_a_plain_folder(spark, tmp_path):
    path = f"{tmp_path}/plain"
    spark.createDataFrame([("a", 1)], "key string, value long").write.parquet(path)
    append_new(spark.createDataFrame([("a", 2), ("b", 2)], "key string, value long"), path, ["key"])
    assert rows(spark.read.parquet(path)) == [("a", 1), ("b", 2)]


def test_scratch_ends_with_its_scope(spark, tmp_path):
    kept = written(spark.range(3), "kept")
    with scratch_scope(spark):
        inner = written(spark.range(5), "inner")
        files = inner.inputFiles()
        name = bucketed_table(spark, new_folder(spark, "t"), inner.schema, ["id"], 2)
        note_table(spark, name)
        with pytest.raises(ZeroDivisionError), scratch_scope(spark):
            nested = written(spark.range(2), "nested").inputFiles()
            raise ZeroDivisionError
        assert not os.path.exists(nested[0].removeprefix("file://")) and os.path.exists(files[0].removeprefix("file://"))
    assert not os.path.exists(files[0].removeprefix("file://")) and not spark.catalog.listTables()
    assert kept.count() == 3
