import json

from hazardlens import schemas
from hazardlens.plans import names, projects
from hazardlens.sources.documents import parse_column, readable
from tests.conftest import rows


def test_clean_raw_list(spark):
    lines = spark.createDataFrame([("Express - web",), ("express",), ("",), (" - x",), ("Left-Pad - a - b",)], "value string")
    assert rows(names.clean_raw_list(lines)) == [("express",), ("left-pad",)]


def test_merge_lists(spark):
    top = spark.createDataFrame([(" A ",), (None,), ("b",)], "package_name string")
    summary = spark.createDataFrame([("a",), ("c",), (" ",)], "package_name string")
    assert rows(names.merge_lists(top, summary)) == [("a",), ("b",), ("c",)]


def test_batches(spark):
    frame = spark.createDataFrame([(f"P{n}", n) for n in range(250)] + [("p0", 900), (" ", 901)], "package_name string, seq long")
    batches = sorted(names.request_batches(frame).collect())
    assert [(batch["batch_index"], batch["package_count"]) for batch in batches] == [(1, 100), (2, 100), (3, 50)]
    assert [name for batch in batches for name in batch["packages"]] == [f"p{n}" for n in range(250)]
    assert json.loads(batches[2]["request"])["queries"][0] == {"package": {"name": "p200", "ecosystem": "npm"}}


def test_pending_and_outcomes(spark):
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "k string")
    stored = spark.createDataFrame([("a",), ("z",)], "k string")
    fetched = spark.createDataFrame([("b", True), ("c", False)], "k string, found boolean")
    assert rows(names.pending(wanted, stored, ["k"])) == [("b",), ("c",), ("d",)]
    assert rows(names.outcomes(wanted, stored, fetched, "k")) == [
        ("failed", 1), ("not_found", 1), ("skipped", 1), ("success", 1)]


def test_negative_sample(spark):
    candidates = spark.createDataFrame([
        ("Bad", None), ("bad", "npm"), ("bad", "PyPI"), ("good", ""), (" GOOD ", "npm"), ("", "npm")],
        "package_name string, ecosystem string")
    summary = spark.createDataFrame([("bad", "npm"), ("bad", "npm")], "package_name string, ecosystem string")
    assert rows(names.negative_sample(candidates, summary)) == [("bad", "pypi"), ("good", "npm")]
    assert names.negative_sample_counts(candidates, summary).first().asDict() == {
        "total_candidates": 5, "removed_vulnerable": 2, "removed_duplicates": 1, "kept": 2}


def test_project_documents(spark):
    texts = spark.createDataFrame([
        (" Lib ", json.dumps({"stars": 3, "versions": [{"n": 1}, {"n": 2}], "normalized_licenses": ["MIT", "ISC"],
                              "latest_release_published_at": "2020-01-01T00:00:00.000Z"})),
        ("text", json.dumps({"platform": "NPM", "versions": "none", "normalized_licenses": "MIT"})),
        ("broken", "{")], "package_name string, document string")
    table = projects.project_rows(readable(parse_column(texts, "document", schemas.PROJECT_DOCUMENT)))
    assert rows(table, "package_name", "platform", "stars", "versions_count", "normalized_licenses") == [
        ("lib", "npm", 3, 2, "MIT;ISC"), ("text", "NPM", None, None, "MIT")]


def test_dependency_documents(spark):
    texts = spark.createDataFrame([
        ("lib", "1.0", json.dumps({"dependencies": [{"kind": "runtime"}, {"kind": "development"}, {"kind": ""}, {}]})),
        ("odd", "1.0", json.dumps({"dependencies": "none"})), ("old", "0.9", json.dumps({"dependencies": []}))],
        "package_name string, version string, document string")
    parsed = readable(parse_column(texts, "document", schemas.DEPENDENCY_DOCUMENT))
    table = spark.createDataFrame(
        [("LIB", "", " 1.0 "), ("odd", "NPM", "1.0"), ("old", None, "1.0"), ("none", None, "")],
        "package_name string, platform string, latest_release_number string")
    for column in ("dependents_count", "dependent_repos_count", "latest_release_published_at", "versions_count"):
        table = table.selectExpr("*", f"CAST(NULL AS BIGINT) AS {column}")
    found = projects.dependency_rows(table, parsed)
    assert rows(found, "package_name", "platform", "runtime_dependencies_count") == [("lib", "npm", 3), ("odd", "NPM", 0)]
