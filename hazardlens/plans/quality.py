"""Checks of the package summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.fixed_values import HIGH_SEVERITY_FROM
from hazardlens.functions.numbers import lenient_decimal, lenient_integer, percent
from hazardlens.functions.text import not_blank

HEALTHY_BELOW = 0.95
EXAMPLES = 5


def _high_count() -> Column:
    return F.coalesce(lenient_integer(F.col("high_severity_count").cast("string")), F.lit(0))


def _score() -> Column:
    return lenient_decimal(F.col("max_severity_score").cast("string"))


def _inconsistent() -> Column:
    """The count and the highest score disagree about a high severity being there."""
    return (_high_count() > 0) != F.coalesce(_score() >= HIGH_SEVERITY_FROM, F.lit(False))


def blank_counts(summary: DataFrame) -> DataFrame:
    blank = F.count_if(~not_blank(F.col("high_severity_count").cast("string")))
    return summary.agg(blank.alias("blanks"), F.when(blank == 0, "PASS").otherwise("FAIL").alias("verdict"))


def inconsistencies(summary: DataFrame) -> DataFrame:
    """All rows whose count and score disagree."""
    return summary.where(_inconsistent()).select(
        "package_name", _high_count().alias("high_severity_count"), _score().alias("max_severity_score"))


def inconsistency_report(summary: DataFrame) -> DataFrame:
    """Number of disagreeing rows and the first few of them by name."""
    examples = inconsistencies(summary).orderBy("package_name").limit(EXAMPLES)
    total = summary.agg(F.count_if(_inconsistent())).scalar()
    return examples.withColumn("errors", total)


def distribution(summary: DataFrame) -> DataFrame:
    rows, high = F.count(F.lit(1)), F.count_if(_high_count() > 0)
    healthy = (high > 0) & (high < rows * HEALTHY_BELOW)
    return summary.agg(
        high.alias("high_packages"), percent(high, rows, 1).alias("high_share"),
        (rows - high).alias("other_packages"), percent(rows - high, rows, 1).alias("other_share"),
        F.when(healthy, "PASS").otherwise("CAUTION").alias("verdict"))
