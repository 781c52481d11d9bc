"""The package risk table, its scores and the findings drawn from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions.dates import days_since
from hazardlens.functions.numbers import count_if, number_or_zero, percent
from hazardlens.functions.text import equals_word, has_text, normalize_name, null_if_blank
from hazardlens.operators.keys import last_per_key


def risk_summary(summary: DataFrame, projects: DataFrame, as_of: Column) -> DataFrame:
    """Every package known to either side, joined on the normalized name.

    Both sides hold one row per name before the join, so no key can be hot in it. Both have a ``seq``
    column that says which of several rows for a name is the last.
    """
    vulnerable = summary.select(
        normalize_name(F.col("package_name")).alias("_key"),
        "vulnerability_count", "high_severity_count", "max_severity_score", "seq").where("_key <> ''")
    vulnerable = last_per_key(vulnerable, ["_key"], "seq").drop("seq")
    keyed = projects.withColumn("_key", normalize_name(F.col("package_name"))).where("_key <> ''")
    described = last_per_key(keyed, ["_key"], "seq")
    joined = vulnerable.join(described, "_key", "full_outer")
    return joined.select(
        F.coalesce(null_if_blank(F.col("package_name")), F.col("_key")).alias("package_name"),
        F.lit(fixed.ECOSYSTEM).alias("ecosystem"),
        "stars", "forks", "contributions_count", "dependent_repos_count", "dependents_count", "rank",
        "repository_status", "latest_release_published_at", "versions_count",
        days_since(F.col("latest_release_published_at"), as_of).alias("days_since_last_release"),
        has_text(F.col("repository_url")).alias("has_repository"),
        equals_word(F.col("repository_status"), "unmaintained").alias("is_unmaintained"),
        F.coalesce("vulnerability_count", F.lit(0).cast("long")).alias("vulnerability_count"),
        F.coalesce("high_severity_count", F.lit(0).cast("long")).alias("high_severity_count"),
        "max_severity_score",
        F.coalesce(F.col("high_severity_count") > 0, F.lit(False)).alias("has_high_severity_vulnerability"),
    )


def with_dependencies(risk: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Add the runtime dependency count; packages without a dependency document get NULL."""
    counts = (dependencies.groupBy(normalize_name(F.col("package_name")).alias("_key"))
              .agg(F.max("runtime_dependencies_count").alias("runtime_dependencies_count")))
    return (risk.withColumn("_key", normalize_name(F.col("package_name")))
            .join(counts, "_key", "left").drop("_key"))


def risk_scores(risk: DataFrame) -> DataFrame:
    """Score = vulnerabilities x highest severity x ln(stars + 1); missing numbers count as zero."""
    kinds = dict(risk.dtypes)

    def filled_number(name: str) -> Column:
        """Numbers keep their type; text cells are read first."""
        return number_or_zero(F.col(name)) if kinds[name] == "string" else F.coalesce(name, F.lit(0))
    filled = risk.withColumns({name: filled_number(name) for name in (
        "vulnerability_count", "max_severity_score", "stars")})
    score = F.col("vulnerability_count") * F.col("max_severity_score") * F.log1p("stars")
    return filled.withColumn("risk_score", F.round(score, 2))


def top_risks(scored: DataFrame, size: int = fixed.TOP_BY_RISK) -> DataFrame:
    return (scored.select("package_name", "vulnerability_count", "max_severity_score", "stars", "risk_score")
            .orderBy(F.col("risk_score").desc(), "package_name").limit(size))


def findings(scored: DataFrame) -> DataFrame:
    """Totals, rates, group means and the riskiest package in one row, from one pass."""
    high = F.coalesce(F.col("has_high_severity_vulnerability"), F.lit(False))
    stars = number_or_zero(F.col("stars"))
    riskiest = F.min(F.struct((-F.col("risk_score")).alias("lowered"), "package_name"))
    total, vulnerable, severe = F.count(F.lit(1)), count_if(F.col("vulnerability_count") > 0), count_if(high)
    return scored.agg(
        total.alias("total_packages"),
        vulnerable.alias("vulnerable_packages"), percent(vulnerable, total, 1).alias("vulnerable_rate"),
        severe.alias("high_severity_packages"), percent(severe, total, 1).alias("high_severity_rate"),
        F.round(F.avg(F.when(high, stars)), 1).alias("avg_stars_high"),
        F.round(F.avg(F.when(~high, stars)), 1).alias("avg_stars_other"),
        F.round(F.avg(F.when(high, F.col("days_since_last_release"))), 1).alias("avg_days_high"),
        F.round(F.avg(F.when(~high, F.col("days_since_last_release"))), 1).alias("avg_days_other"),
        riskiest["package_name"].alias("top_risk_package"),
        (-riskiest["lowered"]).alias("top_risk_score"),
    )
