import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions import dates, labels, numbers, severity, text


def one(spark, column, **cells):
    frame = spark.range(1).select(*[F.lit(value).alias(name) for name, value in cells.items()])
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("cell, name", [
    ("  Left-Pad\t\n", "left-pad"), (" @Scope/Pkg﻿", "@scope/pkg"), ("   ", ""), ("", ""), ("a b", "a b")])
def test_normalize_name(spark, cell, name):
    assert one(spark, text.normalize_name(F.col("c")), c=cell) == name


def test_normalize_missing_name(spark):
    assert one(spark, text.normalize_name(F.lit(None).cast("string")), c="x") == ""


@pytest.mark.parametrize("line, name", [
    ("Express - fast - web", "express"), ("left-pad", "left-pad"), (" - nothing", ""), ("a -b", "a -b"), ("\tX ", "x")])
def test_before_dash(spark, line, name):
    assert one(spark, text.before_dash(F.col("c")), c=line) == name


@pytest.mark.parametrize("cell, number", [
    ("12", 12), (" 7 stars", 7), ("-3", -3), ("4.9", 4), ("n/a", None), ("", None), ("99999999999999999999", None)])
def test_lenient_integer(spark, cell, number):
    assert one(spark, numbers.lenient_integer(F.col("c")), c=cell) == number


@pytest.mark.parametrize("cell, number", [
    ("9.8", 9.8), ("7.5/10", 7.5), (".5", 0.5), ("1e1", 10.0), ("CVSS:3.1", None), ("", None), ("-2.", -2.0)])
def test_lenient_decimal(spark, cell, number):
    assert one(spark, numbers.lenient_decimal(F.col("c")), c=cell) == number


@pytest.mark.parametrize("cell, number", [("3", 3.0), ("x", 0.0), ("", 0.0), ("1.5", 1.5)])
def test_number_or_zero(spark, cell, number):
    assert one(spark, numbers.number_or_zero(F.col("c")), c=cell) == number


@pytest.mark.parametrize("cell, answer", [("true", True), ("True", True), ("false", False), ("yes", False), ("", False)])
def test_truth_of_text(spark, cell, answer):
    assert one(spark, numbers.truth(F.col("c")), c=cell) is answer


def test_truth_of_booleans(spark):
    assert one(spark, numbers.truth(F.lit(True)), c=1) is True
    assert one(spark, numbers.truth(F.lit(None).cast("boolean")), c=1) is False


@pytest.mark.parametrize("stars, label", [
    (None, "0 stars"), (0, "0 stars"), (1, "1-100 stars"), (100, "1-100 stars"), (101, "101-500 stars"),
    (500, "101-500 stars"), (1000, "501-1K stars"), (1001, "1K-5K stars"), (10000, "5K-10K stars"),
    (10001, "10K+ stars")])
def test_star_buckets(spark, stars, label):
    ordinal = numbers.range_ordinal(F.lit(stars).cast("long"), fixed.STAR_BUCKETS)
    assert one(spark, numbers.label_at(ordinal, numbers.labels_of(fixed.STAR_BUCKETS)), c=1) == label


@pytest.mark.parametrize("count, label", [
    (None, "0 dependencies"), (0, "0 dependencies"), (5, "1-5 dependencies"), (6, "6-10 dependencies"),
    (20, "11-20 dependencies"), (50, "21-50 dependencies"), (51, "50+ dependencies")])
def test_dependency_buckets(spark, count, label):
    ordinal = numbers.range_ordinal(F.lit(count).cast("long"), fixed.DEPENDENCY_BUCKETS)
    assert one(spark, numbers.label_at(ordinal, numbers.labels_of(fixed.DEPENDENCY_BUCKETS)), c=1) == label


@pytest.mark.parametrize("stars, label", [(None, None), (0, "<100"), (99, "<100"), (100, "100-999"), (100000, "100K+")])
def test_star_bins(spark, stars, label):
    frame = spark.createDataFrame([(stars,)], "stars long")
    ordinal = numbers.bin_ordinal(F.col("stars"), fixed.STAR_BINS)
    assert frame.select(numbers.label_at(ordinal, numbers.labels_of(fixed.STAR_BINS))).first()[0] == label


@pytest.mark.parametrize("score, label", [(9.0, "CRITICAL"), (8.9, "HIGH"), (7.0, "HIGH"), (4.0, "MEDIUM"), (3.9, "LOW")])
def test_severity_category(spark, score, label):
    assert one(spark, labels.severity_category(F.col("c")), c=score) == label


@pytest.mark.parametrize("high, count, dependents, label", [
    (True, 1, 101, "CRITICAL"), (True, 1, 100, "HIGH"), (True, 1, None, "HIGH"), (False, 2, 101, "MEDIUM"),
    (False, 2, 100, "LOW"), (False, 0, 500, "MINIMAL")])
def test_risk_assessment(spark, high, count, dependents, label):
    ordinal = labels.risk_assessment_ordinal(F.lit(high), F.lit(count), F.lit(dependents).cast("long"))
    assert one(spark, numbers.label_at(ordinal, fixed.RISK_ASSESSMENTS), c=1) == label


@pytest.mark.parametrize("moment, days", [
    ("2001-12-31T11:59:59Z", 0), ("2001-12-30T12:00:00Z", 1), ("2001-12-30T12:00:01Z", 0), ("2002-01-01T00:00:00Z", None),
    ("2001-12-30T14:00:00+02:00", 1), ("not a date", None), ("", None)])
def test_days_since(spark, moment, days):
    column = dates.days_since(dates.read_iso(F.col("c")), dates.utc("2001-12-31 12:00:00"))
    assert one(spark, column, c=moment) == days


def test_iso_text(spark):
    frame = spark.createDataFrame([(dt.datetime(2020, 1, 2, 3, 4, 5),)], "t timestamp_ntz")
    assert frame.select(dates.write_iso(F.col("t"))).first()[0] == "2020-01-02T03:04:05.000Z"


@pytest.mark.parametrize("word, score", [("critical", 9.5), ("High", 8.0), ("MEDIUM", 5.5), ("moderate", 5.5), ("low", 2.5),
                                         ("malware", 10.0), ("none", None), ("", None)])
def test_label_score(spark, word, score):
    assert one(spark, severity.label_score(F.col("c")), c=word) == score


def test_percent_of_nothing(spark):
    assert one(spark, numbers.percent(F.lit(1), F.lit(0)), c=1) is None


def test_share_bar(spark):
    assert one(spark, text.share_bar(F.lit(9.9)), c=1) == "█" * 4
