import datetime as dt
import math

from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions.dates import utc
from hazardlens.plans import quality, questions
from hazardlens.plans.risk import findings, risk_scores, risk_summary, with_dependencies
from tests.conftest import rows

SUMMARY = "package_name string, ecosystem string, vulnerability_count long, high_severity_count long, max_severity_score double, seq long"
PROJECT = ("package_name string, stars long, forks long, contributions_count long, dependent_repos_count long, "
           "dependents_count long, rank long, repository_status string, repository_url string, "
           "latest_release_published_at timestamp_ntz, versions_count long, seq long")


def risk(spark):
    summary = spark.createDataFrame([("both", "npm", 3, 1, 9.0, 1), ("only-vulnerable", "npm", 2, 0, 5.5, 2), (" ", "npm", 1, 1, 9.9, 3)], SUMMARY)
    projects = spark.createDataFrame([
        ("Both", 1, 1, 1, 1, 1, 1, "Active", "", dt.datetime(2001, 1, 1), 1, 1),
        ("BOTH ", 100, 5, 6, 7, 101, 8, " UNMAINTAINED ", " ", dt.datetime(2001, 12, 30), 9, 2),
        ("Only-Project", None, None, None, None, None, None, None, "http://x", dt.datetime(2030, 1, 1), None, 3),
        ("\t", 1, 1, 1, 1, 1, 1, None, None, None, 1, 4),
    ], PROJECT)
    return risk_summary(summary, projects, utc("2001-12-31 12:00:00"))


def test_last_summary_row_of_a_name_counts(spark):
    projects = spark.createDataFrame([], PROJECT)
    for order in ((1, 2), (2, 1)):
        summary = spark.createDataFrame([("x", "npm", 1, 0, 1.0, order[0]), ("X ", "other", 9, 0, 2.0, order[1])], SUMMARY)
        found = risk_summary(summary, projects, utc("2001-12-31 12:00:00")).first()
        assert found["vulnerability_count"] == (9 if order[1] == 2 else 1)


def test_risk_summary(spark):
    found = {row["package_name"].strip().lower(): row for row in risk(spark).collect()}
    assert set(found) == {"both", "only-vulnerable", "only-project"}
    both = found["both"]
    assert both["package_name"] == "BOTH " and both["stars"] == 100
    assert both["days_since_last_release"] == 1 and both["is_unmaintained"] and not both["has_repository"]
    assert both["has_high_severity_vulnerability"] is True
    lone = found["only-project"]
    assert (lone["vulnerability_count"], lone["high_severity_count"], lone["max_severity_score"]) == (0, 0, None)
    assert lone["days_since_last_release"] is None and lone["has_repository"] and not lone["is_unmaintained"]
    bare = found["only-vulnerable"]
    assert bare["stars"] is None and bare["has_high_severity_vulnerability"] is False
    assert risk(spark).columns == fixed.RISK_COLUMNS


def test_scores_and_findings(spark):
    scored = risk_scores(risk(spark))
    score = {row["package_name"]: row["risk_score"] for row in scored.collect()}
    assert score["BOTH "] == round(3 * 9.0 * math.log1p(100), 2) and score["Only-Project"] == 0.0
    line = findings(scored).first()
    assert (line["total_packages"], line["vulnerable_packages"], line["high_severity_packages"]) == (3, 2, 1)
    assert line["top_risk_package"] == "BOTH " and line["vulnerable_rate"] == 66.7


def test_dependencies(spark):
    dependencies = spark.createDataFrame([(" both", 4), ("BOTH", 2)], "package_name string, runtime_dependencies_count long")
    joined = with_dependencies(risk(spark), dependencies)
    assert rows(joined, "package_name", "runtime_dependencies_count") == [
        ("BOTH ", 4), ("Only-Project", None), ("only-vulnerable", None)]


def test_all_zero_dependents_give_no_share(spark):
    zero = risk(spark).withColumn("dependents_count", F.lit(0).cast("long"))
    assert [row["percentage_of_total_dependents"] for row in questions.top_unmaintained(zero).collect()] == [None]


def test_null_flag_is_a_group_of_its_own(spark):
    frame = spark.createDataFrame([(5, None), (6, False), (7, True)], "stars long, has_high_severity_vulnerability boolean")
    assert len(questions.stars_by_status(frame).collect()) == 3


def test_single_row_group_has_no_deviation(spark):
    frame = spark.createDataFrame([(5, True)], "stars long, has_high_severity_vulnerability boolean")
    assert questions.stars_by_status(frame).first()["stddev_stars"] is None


def test_quality(spark):
    good = spark.createDataFrame([("a", "1", "9.0"), ("b", "0", ""), ("c", "0", "6.9")],
                                 "package_name string, high_severity_count string, max_severity_score string")
    assert quality.blank_counts(good).first()["verdict"] == "PASS"
    assert quality.inconsistencies(good).count() == 0
    assert quality.distribution(good).first()["verdict"] == "PASS"
    bad = good.unionByName(spark.createDataFrame([("d", "", "7.0"), ("e", "2", "")], good.schema))
    assert quality.blank_counts(bad).first().asDict() == {"blanks": 1, "verdict": "FAIL"}
    assert rows(quality.inconsistencies(bad), "package_name") == [("d",), ("e",)]
    assert quality.distribution(good.where("package_name = 'a'")).first()["verdict"] == "CAUTION"
