"""The ten analytical questions over the risk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions import labels
from hazardlens.functions.numbers import (count_if, label_at, labels_of, percent, positive, range_ordinal)


def _rows() -> Column:
    return F.count(F.lit(1))


def _high() -> Column:
    return F.col("has_high_severity_vulnerability")


def _count() -> Column:
    return F.col("vulnerability_count")


def _vulnerable() -> Column:
    return count_if(_count() > 0)


def _mean(value: Column, digits: int) -> Column:
    return F.round(F.avg(value), digits)


def _share_of_groups(size: str) -> Column:
    """Percent of the sum of an already grouped column; the window sees one row per group label."""
    return percent(F.col(size), F.sum(size).over(W.partitionBy(F.lit(0))))


def dataset_totals(risk: DataFrame) -> DataFrame:
    return risk.agg(
        _rows().alias("total_packages"),
        _vulnerable().alias("vulnerable_packages"),
        count_if((_count() == 0) | _count().isNull()).alias("non_vulnerable_packages"),
        percent(_vulnerable(), _rows()).alias("vulnerability_percentage"),
        count_if(_high()).alias("packages_with_high_severity"),
        percent(count_if(_high()), _rows()).alias("high_severity_percentage"),
    )


def _spread_by_status(risk: DataFrame, column: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Mean, extremes and deviation per high-severity flag; the NULL flag is a group of its own."""
    mean, low, high, deviation = names
    value = F.col(column)
    grouped = risk.where(value > 0).groupBy(_high().alias("_high")).agg(
        _rows().alias("package_count"), _mean(value, 2).alias(mean), F.min(value).alias(low),
        F.max(value).alias(high), F.round(F.stddev_samp(value), 2).alias(deviation))
    return (grouped.withColumn("vulnerability_status", labels.vulnerability_status(F.col("_high")))
            .orderBy(F.col("vulnerability_status").desc())
            .select("vulnerability_status", "package_count", *names))


def stars_by_status(risk: DataFrame) -> DataFrame:
    return _spread_by_status(risk, "stars", ("avg_stars", "min_stars", "max_stars", "stddev_stars"))


def dependencies_by_status(risk: DataFrame) -> DataFrame:
    return _spread_by_status(risk, "runtime_dependencies_count", (
        "avg_runtime_dependencies", "min_dependencies", "max_dependencies", "stddev_dependencies"))


def top_by_vulnerability_count(risk: DataFrame) -> DataFrame:
    best = risk.where(_count() > 0).orderBy(
        _count().desc_nulls_first(), F.col("high_severity_count").desc_nulls_first(),
        F.col("max_severity_score").desc_nulls_first(), "package_name").limit(fixed.TOP_BY_COUNT)
    return best.select(
        "package_name", "ecosystem", "vulnerability_count", "high_severity_count", "max_severity_score", "stars",
        "forks", "dependents_count", "is_unmaintained", "days_since_last_release",
        labels.risk_category(_high(), _count()).alias("risk_category"))


def repository_status_distribution(risk: DataFrame) -> DataFrame:
    grouped = risk.groupBy("repository_status").agg(
        _rows().alias("package_count"), _vulnerable().alias("vulnerable_packages"),
        percent(_vulnerable(), _rows()).alias("vulnerability_rate"),
        _mean(positive(F.col("stars")), 2).alias("avg_stars"),
        _mean(F.col("days_since_last_release"), 1).alias("avg_days_since_release"))
    return (grouped.withColumn("percentage_of_total", _share_of_groups("package_count"))
            .orderBy(F.col("package_count").desc(), F.col("repository_status").asc_nulls_last())
            .select("repository_status", "package_count", "percentage_of_total", "vulnerable_packages",
                    "vulnerability_rate", "avg_stars", "avg_days_since_release"))


def release_recency(risk: DataFrame) -> DataFrame:
    days = F.col("days_since_last_release")
    known = F.when(days >= 0, days)
    grouped = (risk.where(days.isNotNull())
               .groupBy(labels.vulnerability_category_ordinal(_high(), _count()).alias("_place")).agg(
        _rows().alias("package_count"), _mean(known, 1).alias("avg_days_since_release"),
        F.min(known).alias("min_days"), F.max(known).alias("max_days"),
        F.round(F.stddev_samp(known), 1).alias("stddev_days")))
    return grouped.orderBy("_place").select(
        label_at(F.col("_place"), fixed.VULNERABILITY_CATEGORIES).alias("vulnerability_category"),
        "package_count", "avg_days_since_release", "min_days", "max_days", "stddev_days")


def top_by_severity(risk: DataFrame) -> DataFrame:
    score = F.col("max_severity_score")
    best = risk.where(score > 0).orderBy(
        score.desc_nulls_first(), _count().desc_nulls_first(), "package_name").limit(fixed.TOP_BY_SEVERITY)
    return best.select(
        "package_name", "ecosystem", "max_severity_score", "vulnerability_count", "high_severity_count", "stars",
        "dependents_count", "is_unmaintained", "repository_status", "days_since_last_release",
        labels.severity_category(score).alias("severity_category"))


def _bucket_report(risk: DataFrame, column: str, buckets: list[tuple[str, int | None]], title: str,
                   last: Column) -> DataFrame:
    """Vulnerability statistics per bucket of a count column, in bucket order."""
    grouped = risk.groupBy(range_ordinal(F.col(column), buckets).alias("_place")).agg(
        _rows().alias("package_count"),
        _mean(positive(_count()), 2).alias("avg_vulnerabilities"),
        _vulnerable().alias("vulnerable_packages"),
        percent(_vulnerable(), _rows()).alias("vulnerability_rate"),
        _mean(positive(F.col("high_severity_count")), 2).alias("avg_high_severity"),
        last)
    return (grouped.withColumn("percentage", _share_of_groups("package_count")).orderBy("_place")
            .withColumn(title, label_at(F.col("_place"), labels_of(buckets))).drop("_place"))


def statistics_by_stars(risk: DataFrame) -> DataFrame:
    severity = _mean(positive(F.col("max_severity_score")), 2).alias("avg_max_severity_score")
    return _bucket_report(risk, "stars", fixed.STAR_BUCKETS, "stars_bucket", severity).select(
        "stars_bucket", "package_count", "percentage", "avg_vulnerabilities", "vulnerable_packages",
        "vulnerability_rate", "avg_high_severity", "avg_max_severity_score")


def statistics_by_dependencies(risk: DataFrame) -> DataFrame:
    dependents = _mean(positive(F.col("dependents_count")), 1).alias("avg_dependents")
    return _bucket_report(
        risk, "runtime_dependencies_count", fixed.DEPENDENCY_BUCKETS, "dependencies_bucket", dependents).select(
        "dependencies_bucket", "package_count", "percentage", "avg_vulnerabilities", "vulnerable_packages",
        "vulnerability_rate", "avg_high_severity", "avg_dependents")


def top_unmaintained(risk: DataFrame) -> DataFrame:
    """The share is of all selected packages, not of the listed ones, so the sum is a query of its own.

    The input is read twice: give it as a stored table.
    """
    dependents = F.col("dependents_count")
    selected = risk.where(F.col("is_unmaintained") & (_count() > 0))
    all_dependents = selected.agg(F.sum(dependents)).scalar()
    place = labels.risk_assessment_ordinal(_high(), _count(), dependents)
    best = selected.withColumn("_place", place).orderBy(
        "_place", dependents.desc_nulls_first(), F.col("high_severity_count").desc_nulls_first(),
        F.col("max_severity_score").desc_nulls_first(), "package_name").limit(fixed.TOP_UNMAINTAINED)
    return best.select(
        "package_name", "ecosystem", "vulnerability_count", "high_severity_count", "max_severity_score", "stars",
        "dependents_count", "dependent_repos_count", "days_since_last_release", "repository_status", "rank",
        label_at(F.col("_place"), fixed.RISK_ASSESSMENTS).alias("risk_assessment"),
        percent(dependents, all_dependents).alias("percentage_of_total_dependents"))
