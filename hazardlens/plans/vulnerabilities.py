"""Vulnerability documents to flat rows, flat rows to one row per package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions.dates import read_iso
from hazardlens.functions.severity import is_high, severity_of
from hazardlens.functions.text import normalize_name, null_if_blank, strip


def of_ecosystem(entry: Column) -> Column:
    return entry["package"].isNotNull() & (F.lower(entry["package"]["ecosystem"]) == fixed.ECOSYSTEM)


def flatten(documents: DataFrame, others: list[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per affected package entry of the ecosystem; wants the fields of VULNERABILITY_DOCUMENT.

    Unreadable documents have no entries and drop out. The outer explode keeps the optimizer from
    testing the list in a filter of its own, which would parse each document again. ``others`` are kept beside the
    flat columns; with ``keep_empty`` there is a column ``place``, the entry's place in its document, and a
    document without entries has one row, with place -1.
    """
    verdict = severity_of(F.col("id"), F.col("severity"), F.col("database_specific"))
    fields = ["id", "published", "modified", "verdict", *(others or [])]
    judged = documents.withColumn("verdict", verdict)

    if keep_empty:
        entries = judged.select(*fields, F.posexplode_outer(F.filter("affected", of_ecosystem)).alias("place", "entry"))
        kept = [*(others or []), F.coalesce("place", F.lit(-1)).alias("place")]
    else:
        entries = judged.select(*fields, F.explode_outer("affected").alias("entry")).where(of_ecosystem(F.col("entry")))
        kept = others or []
    score = F.col("verdict.score")
    return entries.select(
        F.col("id").alias("osv_id"),
        normalize_name(F.col("entry.package.name")).alias("package_name"),
        F.lit(fixed.ECOSYSTEM).alias("ecosystem"),
        read_iso(F.col("published")).alias("published"),
        read_iso(F.col("modified")).alias("modified"),
        F.col("verdict.type").alias("severity_type"),
        F.round(score, 1).alias("severity_score"),
        is_high(score).alias("is_high_severity"),
        (F.col("verdict.type") == "MALWARE").alias("is_malware"),
        *kept,
    )


def _clean(flat: DataFrame) -> DataFrame:
    return flat.select(
        normalize_name(F.col("package_name")).alias("package_name"),
        F.coalesce(null_if_blank(normalize_name(F.col("ecosystem"))), F.lit(fixed.ECOSYSTEM)).alias("ecosystem"),
        strip(F.coalesce("osv_id", F.lit(""))).alias("osv_id"),
        "published", "severity_score", "is_high_severity", "seq",
    ).where("package_name <> ''")


def one_row_per_id(flat: DataFrame) -> DataFrame:
    """First row per package and id, by ``seq``. Grouping by the id as well spreads a hot package."""
    def first(column: str) -> Column:
        return F.min_by(column, "seq").alias(column)
    return _clean(flat).groupBy("package_name", "ecosystem", "osv_id").agg(
        first("is_high_severity"), first("severity_score"), first("published"), F.min("seq").alias("seq"))


def package_counts(flat: DataFrame) -> DataFrame:
    """The summary without the id list, and ``seq``, the place of the package's first row.

    Every aggregate is combined before the shuffle.
    """
    return _summarize(one_row_per_id(flat), F.min("seq").alias("seq"))


def package_summary(flat: DataFrame) -> DataFrame:
    """One row per package and ecosystem, with the sorted id list as text.

    The list is one cell, as the 8-column table wants it; jobs that only count read package_counts(), and
    package_ids() has one row per id.
    """
    known = F.when(F.col("osv_id") != "", F.col("osv_id"))
    return _summarize(one_row_per_id(flat), F.array_join(F.array_sort(F.collect_list(known)), "|").alias("osv_ids"))


def package_ids(flat: DataFrame) -> DataFrame:
    """The ids of every package, one row each."""
    return _clean(flat).where("osv_id <> ''").select("package_name", "ecosystem", "osv_id").distinct()


def _summarize(rows: DataFrame, *more: Column) -> DataFrame:
    known = F.col("osv_id") != ""
    high = known & F.coalesce("is_high_severity", F.lit(False))
    return rows.groupBy("package_name", "ecosystem").agg(
        F.count_if(known).alias("vulnerability_count"),
        F.count_if(high).alias("high_severity_count"),
        F.round(F.max(F.when(known, F.col("severity_score"))), 1).alias("max_severity_score"),
        F.max(F.when(known, F.col("published"))).alias("latest_vulnerability_published_at"),
        F.bool_or(high).alias("has_high_severity_vulnerability"),
        *more)
