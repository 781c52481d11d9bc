"""Package name lists, request batches, pending work and the negative sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions.text import before_dash, normalize_name, null_if_blank
from hazardlens.operators.keys import distinct_union, exclude_known
from hazardlens.operators.running import numbered


def clean_raw_list(lines: DataFrame) -> DataFrame:
    """Distinct names from lines such as ``Name - anything``."""
    return lines.select(before_dash(F.col("value")).alias("package_name")).where("package_name <> ''").distinct()


def name_list(rows: DataFrame) -> DataFrame:
    """Distinct normalized names of a table with a package_name column."""
    return rows.select(normalize_name(F.col("package_name")).alias("package_name")).where(
        "package_name <> ''").distinct()


def merge_lists(top: DataFrame, summary: DataFrame) -> DataFrame:
    """Distinct names of two tables. Names of white space alone count as blank."""
    return distinct_union(name_list(top), name_list(summary))


def request_batches(names: DataFrame, size: int = fixed.BATCH_SIZE) -> DataFrame:
    """Full batches of distinct names in order of first appearance, each with its request text.

    ``names`` has package_name and ``seq``, anything that can be ordered, as a number or the place of a row in a
    folder of files. Every name keeps its first ``seq``; names that share one stand in the order of the alphabet.
    """
    distinct = (names.select(normalize_name(F.col("package_name")).alias("package_name"), "seq")
                .where("package_name <> ''").groupBy("package_name").agg(F.min("seq").alias("seq")))
    placed = numbered(distinct, ["seq", "package_name"])
    batch = F.floor((F.col("position") - 1) / size) + 1
    members = F.array_sort(F.collect_list(F.struct("position", "package_name")))
    grouped = placed.groupBy(batch.cast("long").alias("batch_index")).agg(
        F.transform(members, lambda member: member["package_name"]).alias("packages"))
    return grouped.select("batch_index", F.size("packages").cast("long").alias("package_count"), "packages",
                          request_body(F.col("packages")).alias("request"))


def request_body(packages: Column) -> Column:
    """``{"queries":[{"package":{"name":…,"ecosystem":…}}, …]}``"""
    entries = F.transform(packages, lambda name: F.struct(
        F.struct(name.alias("name"), F.lit(fixed.ECOSYSTEM).alias("ecosystem")).alias("package")))
    return F.to_json(F.struct(entries.alias("queries")))


def pending(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct work items that are not stored yet."""
    return exclude_known(wanted.select(*keys).distinct(), stored, keys)


def outcomes(wanted: DataFrame, stored: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Number of work items per outcome.

    ``stored`` holds what an earlier run left; ``fetched`` has the key and a boolean ``found`` for what
    this run asked for. An item that was asked for and got no answer counts as failed.
    """
    items = wanted.select(key).distinct()
    done = stored.select(key).distinct().withColumn("_stored", F.lit(True))
    answers = fetched.groupBy(key).agg(F.bool_or("found").alias("_found"))
    marked = items.join(done, key, "left").join(answers, key, "left")
    outcome = (F.when(F.col("_stored"), "skipped").when(F.col("_found"), "success")
               .when(~F.col("_found"), "not_found").otherwise("failed"))
    return marked.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("items"))


def _candidate_copies(candidates: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per candidate key with its number of copies and whether the key is known as vulnerable."""
    ecosystem = F.coalesce(null_if_blank(normalize_name(F.col("ecosystem"))), F.lit(fixed.ECOSYSTEM))
    keys = ["package_name", "ecosystem"]
    folded = (candidates.select(normalize_name(F.col("package_name")).alias("package_name"),
                                ecosystem.alias("ecosystem"))
              .where("package_name <> ''").groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))
    known = (summary.select(normalize_name(F.col("package_name")).alias("package_name"),
                            ecosystem.alias("ecosystem"))
             .where("package_name <> ''").distinct().withColumn("vulnerable", F.lit(True)))
    return folded.join(known, keys, "left")


def negative_sample(candidates: DataFrame, summary: DataFrame) -> DataFrame:
    """Distinct candidates that are not listed as vulnerable."""
    return _candidate_copies(candidates, summary).where("vulnerable IS NULL").select("package_name", "ecosystem")


def negative_sample_counts(candidates: DataFrame, summary: DataFrame) -> DataFrame:
    """Candidate rows read, removed as vulnerable, removed as repeats, kept."""
    vulnerable = F.col("vulnerable").isNotNull()
    return _candidate_copies(candidates, summary).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_candidates"),
        F.coalesce(F.sum(F.when(vulnerable, F.col("copies"))), F.lit(0)).alias("removed_vulnerable"),
        F.coalesce(F.sum(F.when(~vulnerable, F.col("copies") - 1)), F.lit(0)).alias("removed_duplicates"),
        F.count_if(~vulnerable).alias("kept"))
