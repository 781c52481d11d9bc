import json
import random

from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens import schemas
from hazardlens.__main__ import main
from hazardlens.learning import scoring
from hazardlens.session import new_folder
from hazardlens.sources import csv_files
from tests.conftest import rows


def test_documents_to_scores_through_files(spark, tmp_path, capsys):
    details, project_files, dependency_files = tmp_path / "details", tmp_path / "projects", tmp_path / "dependencies"
    dependency_files.mkdir()
    for file, count in [("lib@1.0", 3), ("@org%2Ftool@1.0", 12), ("calm@0.9", 1)]:
        (dependency_files / f"{file}.json").write_text(json.dumps({"dependencies": [{"kind": "runtime"}] * count}))
    details.mkdir()
    project_files.mkdir()
    for osv_id, score, names in [("A-1", 9.8, ["lib", "@org/tool"]), ("A-2", 5.0, ["lib"]), ("MAL-1", None, ["bad"])]:
        own = {"cvss": {"score": score}} if score else {}
        (details / f"{osv_id}.json").write_text(json.dumps({
            "id": osv_id, "published": "2020-01-01T00:00:00Z", "database_specific": own,
            "affected": [{"package": {"name": name, "ecosystem": "npm"}} for name in names]}, indent=1))
    (details / "broken.json").write_text("{")
    for name, stars in [("lib", 100), ("@org%2Ftool", 5), ("calm", 7)]:
        (project_files / f"{name}.json").write_text(json.dumps({
            "stars": stars, "description": 'a "b", c\nd', "repository_status": "Unmaintained",
            "latest_release_number": "1.0", "latest_release_published_at": "2020-12-31T00:00:00Z", "versions": [{}, {}], "normalized_licenses": ["MIT", "ISC"]}, indent=1))
    out = {name: new_folder(spark, name) for name in ("flat", "projects", "summary", "risk", "scored", "tables", "names", "batches", "needs", "answers", "profiles", "todo",
                                                 "appended")}

    def run(*arguments):
        main([str(argument) for argument in arguments], spark)

    run("flatten", details, "--out", out["flat"])
    run("project-table", project_files, "--out", out["projects"])
    run("package-summary", out["flat"], "--out", out["summary"])
    run("risk-summary", out["summary"], out["projects"], "--as-of", "2021-01-02 00:00:00", "--out", out["risk"])
    run("risk-scores", out["risk"], "--out", out["scored"])
    run("load", out["flat"], out["projects"], out["summary"], out["risk"], "--out", out["tables"])
    run("dependency-table", out["projects"], dependency_files, "--out", out["needs"])
    run("questions", f"{out['tables']}/extracted_package_risk_summary", out["needs"], "--out", out["answers"])
    run("profiles", out["risk"], out["needs"], "--out", out["profiles"])
    run("pending-work", out["projects"], out["needs"], "--out", out["todo"])
    run("project-table", project_files, "--append", "--out", out["appended"])
    run("project-table", project_files, "--append", "--out", out["appended"])
    run("findings", out["scored"])
    run("check-summary", out["summary"])
    run("list-from-summary", out["summary"], "--out", out["names"])
    run("request-batches", out["names"], "--out", out["batches"])

    projects = csv_files.read_typed(spark, out["projects"], schemas.PROJECTS)
    assert rows(projects, "package_name", "stars", "versions_count", "normalized_licenses", "description") == [
        ("@org/tool", 5, 2, "MIT;ISC", 'a "b", c\nd'), ("calm", 7, 2, "MIT;ISC", 'a "b", c\nd'),
        ("lib", 100, 2, "MIT;ISC", 'a "b", c\nd')]
    risk = csv_files.read_typed(spark, out["risk"], schemas.RISK_SUMMARY)
    assert rows(risk, "package_name", "stars", "days_since_last_release", "vulnerability_count", "high_severity_count",
                "max_severity_score", "is_unmaintained") == [
        ("@org/tool", 5, 2, 1, 1, 9.8, True), ("bad", None, None, 1, 1, 10.0, False), ("calm", 7, 2, 0, 0, None, True),
        ("lib", 100, 2, 2, 1, 9.8, True)]
    loaded = spark.read.parquet(f"{out['tables']}/raw_librariesio_projects")
    assert loaded.columns == fixed.PROJECT_COLUMNS and loaded.where(F.col("forks") == 0).count() == 3
    needs = csv_files.read_typed(spark, out["needs"], schemas.DEPENDENCIES)
    assert rows(needs, "package_name", "runtime_dependencies_count", "latest_release_number") == [
        ("@org/tool", 12, "1.0"), ("lib", 3, "1.0")]
    batch = spark.read.json(out["batches"]).first()
    assert batch["package_count"] == 3 and json.loads(batch["request"])["queries"][0]["package"]["ecosystem"] == "npm"
    assert spark.read.parquet(out["appended"]).count() == 3
    assert rows(csv_files.read_by_header(spark, out["todo"])) == [("calm",)]
    answer = csv_files.read_by_header(spark, f"{out['answers']}/top_by_vulnerability_count")
    assert answer.count() == 3 and "package_name" in answer.columns
    assert csv_files.read_by_header(spark, f"{out['profiles']}/class_distribution").count() == 2
    shown = capsys.readouterr().out
    assert "CRITICAL" in shown and "10K+ stars" not in shown and "top_risk_package" in shown and "PASS" in shown
    assert "11-20 dependencies" in shown and "0 dependencies" in shown


def test_scored_table_trains_a_model_that_predicts(spark, capsys):
    draw = random.Random(3)
    out = {name: new_folder(spark, name) for name in ("risk", "scored", "model", "predicted", "sweep", "figures", "high")}
    lines = [(f"p{n}", "npm", draw.randint(0, 999), 1, 2, 3, 4, 5, draw.choice(["Active", "Deprecated", None]), None, n % 40,
              n, True, n % 5 == 0, n % 4, n % 2, float(n % 10), n % 2 == 1) for n in range(150)]
    csv_files.write_cells(spark.createDataFrame(lines, schemas.RISK_SUMMARY), out["risk"], fixed.RISK_COLUMNS)

    def run(*arguments):
        main([str(argument) for argument in arguments], spark)

    run("risk-scores", out["risk"], "--out", out["scored"])
    run("train", out["scored"], "--models", "Logistic Regression", "--out", out["model"])
    run("predict", out["model"], out["scored"], "--out", out["predicted"], "--tables", "csv")
    run("predict", out["model"], out["scored"], "--threshold", "2", "--out", out["high"])
    run("what-if", out["model"], out["scored"], "--out", out["sweep"])
    run("diagnostics", out["model"], out["risk"], "--no-line-breaks", "--out", out["figures"])
    threshold = scoring.load_model(spark, out["model"]).threshold
    found = csv_files.read_by_header(spark, out["predicted"])
    assert found.count() == 150
    high = F.col("probability_vulnerable").cast("double") >= threshold
    assert found.where((F.col("prediction") == fixed.POSITIVE_LABEL) != high).count() == 0
    assert csv_files.read_by_header(spark, out["high"]).where(F.col("prediction") == fixed.POSITIVE_LABEL).count() == 0
    assert csv_files.read_by_header(spark, out["sweep"]).count() == 900
    assert csv_files.read_by_header(spark, f"{out['figures']}/quality_at_safety_threshold").count() == 1
    assert "feature importance" in csv_files.read_by_header(spark, f"{out['model']}/report").toPandas()["section"].values


def test_line_order_follows_file_names(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("name,n\nfirst,0\n")
    (tmp_path / "part-1.csv").write_text("name,n\n" + "".join(f"row {n},{n}\n" for n in range(1, 51)))
    found = csv_files.read_typed(spark, str(tmp_path), "n int, name string, missing long", with_seq=True)
    assert [row["n"] for row in found.orderBy("seq").collect()] == list(range(51))
    assert found.where("missing IS NOT NULL").count() == 0


def test_batches_follow_files_and_lines(spark, tmp_path):
    """The second file is the larger one, which Spark packs first."""
    folder = tmp_path / "lists"
    folder.mkdir()
    small, large = [f"small{i}" for i in range(10, 0, -1)], [f"large{i}" for i in range(3000, 0, -1)]
    for name, found in (("a.csv", small), ("b.csv", large)):
        (folder / name).write_text("package_name\n" + "\n".join(found) + "\n")
    main(["request-batches", str(folder), "--out", str(tmp_path / "batches")])
    batches = spark.read.json(str(tmp_path / "batches")).orderBy("batch_index").collect()
    assert [name for batch in batches for name in batch["packages"]] == small + large


def test_csv_to_json_in_splits(spark, tmp_path):
    source = tmp_path / "table.csv"
    source.write_text("a,b\n" + "".join(f"{i},word{i}\n" for i in range(20_000)))
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        main(["csv-to-json", str(source), "--no-line-breaks", "--out", str(tmp_path / "split")])
        main(["csv-to-json", str(source), "--out", str(tmp_path / "whole")])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list((tmp_path / "split").glob("part-*"))) > 3 and len(list((tmp_path / "whole").glob("part-*"))) == 1
    assert spark.read.json(str(tmp_path / "split")).exceptAll(spark.read.json(str(tmp_path / "whole"))).isEmpty()
    assert spark.read.json(str(tmp_path / "split")).count() == 20_000
