"""Profile tables of the risk data, one per figure or printed report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions.dates import write_iso
from hazardlens.functions.numbers import bin_ordinal, flag, label_at, labels_of, percent
from hazardlens.operators import shapes


def _rows() -> Column:
    return F.count(F.lit(1))


def _high() -> Column:
    return F.col("has_high_severity_vulnerability")

_TEXT_COLUMNS = ["package_name", "ecosystem", "repository_status", "latest_release_published_at"]
describe = shapes.describe


def missing(risk: DataFrame) -> DataFrame:
    """Columns with missing values, most first, with count and percent."""
    tallies = risk.agg(_rows().alias("_rows"), *[F.count_if(F.col(name).isNull()).alias(name) for name in risk.columns])
    lines = tallies.unpivot(["_rows"], risk.columns, "column_name", "missing_count").where("missing_count > 0")
    return lines.orderBy(F.col("missing_count").desc(), "column_name").select(
        "column_name", "missing_count", percent(F.col("missing_count"), F.col("_rows")).alias("missing_percent"))


def missing_totals(risk: DataFrame) -> DataFrame:
    nulls = F.lit(0).cast("long")
    for name in risk.columns:
        nulls = nulls + F.count_if(F.col(name).isNull())
    return risk.agg(nulls.alias("missing_cells"), (_rows() * len(risk.columns)).alias("total_cells"))


def text_value_counts(risk: DataFrame) -> DataFrame:
    texts = risk.withColumn("latest_release_published_at", write_iso(F.col("latest_release_published_at")))
    return shapes.value_counts(texts, _TEXT_COLUMNS).orderBy("column_name", F.col("value_count").desc(), "value")


def _counts_of(risk: DataFrame, column: str, name: str) -> DataFrame:
    """Rows per label with percent; the window sees one row per label."""
    whole = F.sum("packages").over(W.partitionBy(F.lit(0)))
    return (risk.groupBy(F.col(column).alias(name)).agg(_rows().alias("packages"))
            .withColumn("percentage", percent(F.col("packages"), whole, 1)))


def class_distribution(risk: DataFrame) -> DataFrame:
    return _counts_of(risk, fixed.TARGET, "high").orderBy(F.col("packages").desc())


def status_counts(risk: DataFrame) -> DataFrame:
    return (_counts_of(risk, "repository_status", "repository_status").where("repository_status IS NOT NULL")
            .orderBy(F.col("packages").desc(), "repository_status"))


def days_histogram(risk: DataFrame) -> DataFrame:
    """50 bins of days since the last release, with mean and median beside each bin."""
    return shapes.histogram(risk, "days_since_last_release", fixed.HISTOGRAM_BINS)


def _high_label() -> Column:
    return F.when(_high(), F.lit(fixed.HIGH_STATUS)).otherwise(F.lit("Non-Vulnerable"))


def stars_box(risk: DataFrame) -> DataFrame:
    return shapes.box_statistics(risk.withColumn("label", _high_label()), "label", "stars")


def dependencies_box(risk: DataFrame) -> DataFrame:
    return shapes.box_statistics(risk.withColumn("label", _high_label()), "label", "runtime_dependencies_count")


def count_by_maintenance_box(risk: DataFrame) -> DataFrame:
    label = F.when(F.col("is_unmaintained"), F.lit("Unmaintained")).otherwise(F.lit("Maintained"))
    return shapes.box_statistics(risk.withColumn("label", label), "label", "vulnerability_count")


def severity_box(risk: DataFrame) -> DataFrame:
    vulnerable = risk.where("vulnerability_count > 0").withColumn("label", F.lit("vulnerable"))
    return shapes.box_statistics(vulnerable, "label", "max_severity_score")


def stars_and_dependencies(risk: DataFrame) -> DataFrame:
    return risk.select("stars", "runtime_dependencies_count", fixed.TARGET).dropna()


def stars_dependencies_correlation(risk: DataFrame) -> DataFrame:
    return stars_and_dependencies(risk).agg(
        F.round(F.corr("stars", "runtime_dependencies_count"), 3).alias("correlation"), _rows().alias("points"))


def high_rate_by_stars(risk: DataFrame) -> DataFrame:
    """Percent of packages with a high severity per stars bin; bins nobody is in are left out."""
    place = bin_ordinal(F.coalesce("stars", F.lit(0)), fixed.STAR_BINS)
    return (risk.groupBy(place.alias("_place")).agg((F.avg(flag(_high())) * 100).alias("high_rate")).orderBy("_place")
            .select(label_at(F.col("_place"), labels_of(fixed.STAR_BINS)).alias("stars_bucket"), "high_rate"))


def top_by_count(risk: DataFrame) -> DataFrame:
    return (risk.select("package_name", "vulnerability_count")
            .orderBy(F.col("vulnerability_count").desc(), "package_name").limit(fixed.TOP_CHART_BY_COUNT))


def top_by_risk(scored: DataFrame) -> DataFrame:
    return (scored.select("package_name", "risk_score")
            .orderBy(F.col("risk_score").desc(), "package_name").limit(fixed.TOP_BY_RISK))


def stars_and_versions(risk: DataFrame) -> DataFrame:
    return risk.where("stars > 0").select(
        "stars", F.coalesce("versions_count", F.lit(0)).alias("versions_count"), fixed.TARGET)
