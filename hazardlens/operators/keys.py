"""Operators on keys: exclusion, one row per key, distinct names, key checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exclude_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``known``; repeated known keys are folded before the join."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def exclude_stored(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key a big table does not hold, for a small number of rows.

    The table is cut down to the keys at hand first; with few of those its scan is filtered in place and
    the table itself is never shuffled.
    """
    seen = stored.select(*keys).join(rows.select(*keys).distinct(), keys, "left_semi")
    return exclude_known(rows, seen, keys)


#: A table of so many rows at most, counted first, is sent whole to a join.
BROADCAST_ROWS = 100_000


#: A key that holds more than one row in so many is joined without a shuffle; there are no more such keys than this.
HEAVY_KEYS = 1000


def heavy_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that hold more than a share of 1 / HEAVY_KEYS of the rows, found in one pass with map-side counts."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_held"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counted.where(F.col("_held") * HEAVY_KEYS > total).select(key)


def with_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a stored table that has one row per key.

    The table is counted: up to BROADCAST_ROWS rows it is broadcast whole. Beyond that only the entries of heavy
    keys are, HEAVY_KEYS at most by their definition, and the other rows meet the table in a shuffle. Rows of
    a heavy key, or of none, are dealt out evenly in that shuffle.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    others = [name for name in table.columns if name != key]
    entries = F.struct(*others) if others else F.lit(True)
    heavy = table.join(F.broadcast(heavy_keys(rows, key)), key, "left_semi").select(
        F.col(key).alias("_heavy_key"), entries.alias("_heavy"))
    tagged = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy_key"), "left")
    at_home = F.col("_heavy_key").isNull() & F.col(key).isNotNull()
    dealt = tagged.withColumns({"_met": F.when(at_home, F.col(key)),
                                "_dealt": F.when(at_home, F.lit(0)).otherwise(1 + F.monotonically_increasing_id() % 8191)})
    # Always zero, but not a constant: the optimizer would take that out of the join, and with it the dealing.
    home = F.pmod(F.xxhash64(key), F.lit(1))
    met = table.select(F.col(key).alias("_met"), entries.alias("_light"), home.alias("_dealt"))
    joined = dealt.join(met, ["_met", "_dealt"], "left")
    found = F.coalesce("_heavy", "_light")
    return joined.select(*[F.col(c) for c in rows.columns], *[found[name].alias(name) for name in others])


def last_per_key(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the highest sequence per key. Spark limits each map task to one row per key first."""
    newest = W.partitionBy(*keys).orderBy(F.col(sequence).desc())
    return rows.withColumn("_turn", F.row_number().over(newest)).where("_turn = 1").drop("_turn")


def first_per_key(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the lowest sequence per key."""
    oldest = W.partitionBy(*keys).orderBy(F.col(sequence).asc())
    return rows.withColumn("_turn", F.row_number().over(oldest)).where("_turn = 1").drop("_turn")


def distinct_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their row counts."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its number of NULLs; one pass over the table."""
    tallies = rows.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return long_form(tallies, columns, "column_name", "null_count")


def long_form(rows: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    """One row per column of each row."""
    return rows.unpivot([], columns, name, value)
