"""The registered queries of this subpackage.

Each query applies one operator, with its production parameters, to its whole table and returns its full
result. ``check_sql`` has the SQL of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm import check_sql
from hazardlens.llm.cross_polytope import nearest
from hazardlens.llm.decision_list import fit_rules, judged
from hazardlens.llm.fuzzy_lines import without_repeated_lines
from hazardlens.llm.jaccard import jaccard_groups
from hazardlens.llm.katz import katz_scores
from hazardlens.llm.licenses import builtin_licenses, license_scan
from hazardlens.llm.mixing import with_copies
from hazardlens.llm.preferences import preference_pairs, stale_replies
from hazardlens.llm.scratch import table
from hazardlens.llm.secret_scan import secret_scan
from hazardlens.llm.turn_repair import damaged, repair_turns
from hazardlens.llm.warc import read_records, write_archives
from hazardlens.llm.whitening import whitened
from hazardlens.llm.winnowing import contamination


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen side, the one with its last reply gone stale as the rejected side."""
    conversations = table(spark, sf_dir, "conversations")
    pairs = preference_pairs(conversations, stale_replies(conversations))
    return pairs.withColumnRenamed("pair", "conv_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document under the base rules and the learned list."""
    documents = table(spark, sf_dir, "documents")
    rules = fit_rules(documents, table(spark, sf_dir, "labels"))
    return judged(documents, ["doc_id"], rules).select(
        F.col("c0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op3_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: lines removed, and length and digest of the text that stays."""
    done = without_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("lines_removed").cast("long").alias("lines_removed"),
                       F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the trigrams of six sevenths of them."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return katz_scores(table(spark, sf_dir, "documents"), held_out).withColumnRenamed("id", "doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mix = with_copies(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                      F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(
        "text_key").withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived and read back through the index."""
    return read_records(write_archives(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; the owner is its source, a repository its source and language."""
    return secret_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document under word 3-grams and a Jaccard similarity of 0.9."""
    groups = jaccard_groups(table(spark, sf_dir, "documents"), size=3, threshold=90)
    return groups.select(groups["id"].alias("doc_id"), "n_shingles", "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, and licence lines in it."""
    return license_scan(table(spark, sf_dir, "documents"), builtin_licenses(spark)).withColumnRenamed("id", "doc_id")


def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for each row whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage and repair."""
    done = repair_turns(damaged(table(spark, sf_dir, "conversations")), copies_column="copies")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                       F.sha2("repaired", 256).alias("repaired_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened coordinates of every usable embedding."""
    return whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_formatting, op2_quality_rules, op3_fuzzy_lines, op4_katz_backoff,
        op5_mixing, op6_decontamination, op7_warc, op8_secret_scan,
        op9_ngram_jaccard_join, op10_license_scan,
        op11_cross_polytope, op12_turn_repair, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return check_sql.statements()
