"""From raw documents to a training mix: five stages, each a Spark job over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each result to the shared folder, reads it again for the next stage, and then empties it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm.decision_list import fit_rules, good_documents
from hazardlens.llm.fuzzy_lines import without_repeated_lines
from hazardlens.llm.jaccard import one_of_each_group
from hazardlens.llm.mixing import mixed
from hazardlens.llm.scratch import stored_at, table
from hazardlens.llm.winnowing import clean_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects."""
    return good_documents(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; one whose every word was in such lines goes."""
    done = without_repeated_lines(docs)
    emptied = (F.col("lines_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    length = F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.where(~emptied).withColumn("n_chars", F.coalesce(length, "n_chars")).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by word 5-grams at a similarity of 0.8 or more."""
    return one_of_each_group(docs, size=5, threshold=80).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source ask, with the number of the copy."""
    return mixed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
]

#: The learned list and SimHash groups are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, drop = table(spark, sf_dir, "documents"), lambda: None
    for name, stage in STAGES:
        done, drop_done = stored_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop()
        docs, drop = done, drop_done
    return docs
