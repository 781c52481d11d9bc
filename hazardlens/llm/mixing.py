"""Mixing sources to target weights.

Sizes are summed per source and shared out by weight; a source's target over its size is its repetition rate.
A document appears floor(rate) times, and once more if a hash of its id and text, as a number in [0, 1), is
below the rest of the rate. Targets stop at ``most`` times the source's size, and what that frees is shared
again by weight until none is above.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.scratch import free_names, stored

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text_column: str = "text") -> Column:
    """Words of a whole text; a null has none."""
    return F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_column: str = "doc_id", text_column: str = "text", seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on seed, id and text only."""
    digest = F.md5(F.concat_ws("\n", F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")),
                               F.md5(F.coalesce(F.col(text_column), F.lit("")))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight`` to (source, source_size): ``weights`` in turn over the sources by code point, null last.

    Ranks come from a range-partitioned sort and the row counts of its partitions, so no task or window sees
    all sources.
    """
    ordered = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last())
                     .sortWithinPartitions(F.col("source").asc_nulls_last())
                     .withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    counts = sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one line a partition
    first, cells = 0, []
    for row in counts:
        cells += [F.lit(row["part"]), F.lit(first)]
        first += row["n"]
    if not cells:
        return sizes.withColumn("weight", F.lit(1))
    rank = F.create_map(*cells)[part] + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.select("source", "source_size", F.element_at(
        F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).alias("weight"))


#: What ``with_copies`` adds.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def source_targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE,
                   most: int = MOST, text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(source, source_size, target, rate), one row a source; null is a source of its own. Empty sources get 0."""
    sizes = documents.groupBy(F.col(source_column).alias("source")).agg(F.sum(text_size(text_column)).alias("source_size"))
    sources = stored(weighted_sources(sizes, weights), "weighted-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    stopped = F.lit(False)
    full, open_weight = 0, None
    while True:  # each turn stops one more source at least; turns are few, as all that are above stop at once
        row = sources.agg(F.sum(F.when(stopped, F.col("source_size"))).alias("full"),
                          F.sum(F.when(~stopped, F.col("weight"))).alias("open")).first()
        settled = (row["full"] or 0, row["open"] or 0) == (full, open_weight)
        full, open_weight = row["full"] or 0, row["open"] or 0
        if settled or not open_weight:
            break
        rest = total * share.numerator - most * full * share.denominator
        level = (rest, open_weight * share.denominator)  # words a unit of weight, as a fraction
        stopped = F.col("weight") * F.lit(level[0]).cast("decimal(38,0)") >= F.col("source_size") * F.lit(
            most * level[1]).cast("decimal(38,0)")
    if open_weight:
        even = F.col("weight").cast("double") * F.lit(float(level[0])) / F.lit(float(level[1]))
        target = F.when(stopped, (F.col("source_size") * most).cast("double")).otherwise(even)
    else:
        target = (F.col("source_size") * most).cast("double")
    return sources.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def with_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                source_column: str = "source", seed: str = SEED, **options) -> DataFrame:
    """``documents`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``, the times a row is taken.

    All rows stay; a row may have 0 copies. Null ids and texts draw by what is left of them; equal rows draw alike. An
    empty table stays empty. Extra columns are kept; those named as one of the four are replaced.
    """
    if source_column in ADDED or text_column in ADDED or id_column in ADDED:
        raise ValueError(f"columns named {', '.join(ADDED)} are made here")
    documents = documents.drop(*ADDED)
    source, key, rate = free_names(documents, "mix_source", "mix_source_key", "mix_rate")
    targets = source_targets(documents, text_column=text_column, source_column=source_column, **options).select(
        F.col("source").alias(source), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), F.col("rate").alias(rate))
    copies = F.floor(rate) + (draw(id_column, text_column, seed) < F.col(rate) - F.floor(rate)).cast("long")
    return (documents.withColumns({"mix_size": text_size(text_column), key: F.col(source_column)})
            .join(targets, F.col(key).eqNullSafe(F.col(source)), "left")
            .withColumn("mix_copies", copies).drop(source, key, rate))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """Each row of ``documents`` as often as the mix takes it, with ``copy`` counted from 1.

    Nulls, equal rows and empty tables as in ``with_copies``; a column named ``copy`` or as one of those it adds goes.
    """
    columns = [c for c in documents.columns if c not in ("copy", *ADDED)]
    return with_copies(documents, **options).where("mix_copies > 0").select(
        *columns, F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy"))
