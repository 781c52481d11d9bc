"""Project and dependency documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions.dates import read_iso
from hazardlens.functions.text import joined, normalize_name, null_if_blank, or_default, strip


def list_or_text(value: Column) -> Column:
    """A JSON array joined by ``;``, any other value as it is."""
    items = F.try_variant_get(value, "$", "array<string>")
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(is_list, joined(items)).otherwise(F.try_variant_get(value, "$", "string"))


def length_or_null(values: Column) -> Column:
    return F.when(values.isNotNull(), F.size(values)).cast("bigint")


def project_rows(documents: DataFrame) -> DataFrame:
    """Project columns from parsed documents; wants package_name and the fields of PROJECT_DOCUMENT."""
    made = {
        "package_name": normalize_name(F.col("package_name")),
        "platform": F.coalesce("platform", F.lit(fixed.ECOSYSTEM)),
        "normalized_licenses": list_or_text(F.col("normalized_licenses")),
        "latest_release_published_at": read_iso(F.col("latest_release_published_at")),
        "versions_count": length_or_null(F.col("versions")),
    }
    return documents.select(*[made.get(name, F.col(name)).alias(name) for name in fixed.PROJECT_COLUMNS])


def runtime_dependency_count(dependencies: Column) -> Column:
    """Entries whose kind is missing, blank or runtime; zero when there is no list."""
    runtime = F.filter(dependencies, lambda item: F.coalesce(item["kind"], F.lit("")).isin("", "runtime"))
    return F.coalesce(F.size(runtime), F.lit(0)).cast("bigint")


def with_version(projects: DataFrame) -> DataFrame:
    """Projects that have a name and a latest version, both in key form."""
    keyed = projects.withColumns({
        "package_name": normalize_name(F.col("package_name")),
        "latest_release_number": strip(F.coalesce("latest_release_number", F.lit("")))})
    return keyed.where("package_name <> '' AND latest_release_number <> ''")


def dependency_rows(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Dependency columns for each project that has a document for its latest version.

    ``documents`` has package_name, version and a parsed ``dependencies`` list. They are reduced to one
    count per key ahead of the join, so neither side can repeat a key many times.
    """
    counts = documents.groupBy(
        F.col("package_name").alias("_name"), F.col("version").alias("_version")).agg(
        F.max(runtime_dependency_count(F.col("dependencies"))).alias("runtime_dependencies_count"))
    keyed = with_version(projects)
    joined_rows = keyed.join(counts, (keyed["package_name"] == counts["_name"])
                             & (keyed["latest_release_number"] == counts["_version"]))
    made = {
        "platform": or_default(F.col("platform"), fixed.ECOSYSTEM),
        "score": F.lit(None).cast("double") if "score" not in projects.columns else F.col("score"),
    }
    return joined_rows.select(*[made.get(name, F.col(name)).alias(name) for name in fixed.DEPENDENCY_COLUMNS])
