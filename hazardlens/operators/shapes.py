"""Distribution shapes: value counts, histograms, box statistics, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions.numbers import percent
from hazardlens.functions.text import share_bar
from hazardlens.operators.keys import long_form
from hazardlens.operators.ranks import exact_quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def row_total(rows: DataFrame) -> Column:
    return rows.agg(F.count(F.lit(1))).scalar()


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, percent of all rows and text bar of each value of each text column; NULLs are not listed."""
    values = long_form(rows.select(*columns), columns, "column_name", "value")
    counted = values.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("value_count"))
    # Every column adds up to the number of rows, NULLs included, so the rows are not read again for it.
    total = counted.groupBy("column_name").agg(F.sum("value_count").alias("n")).agg(F.max("n")).scalar()
    exact = percent(F.col("value_count"), total, digits=None)
    return counted.where("value IS NOT NULL").select(
        "column_name", "value", "value_count", F.round(exact, 1).alias("percentage"), share_bar(exact).alias("bar"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of numeric columns, one row per column.

    The rows are folded to (column, value, count) once; the means come first so that the deviation is a
    sum of squared distances and loses no digits.
    """
    doubles = rows.select(*[F.col(name).cast("double").alias(name) for name in columns])
    values = long_form(doubles, columns, "column_name", "x").where("x IS NOT NULL")
    counted = values.groupBy("column_name", "x").agg(F.count(F.lit(1)).alias("copies"))
    x, copies = F.col("x"), F.col("copies")
    means = counted.groupBy("column_name").agg((F.sum(x * copies) / F.sum(copies)).alias("mean"))
    by_column = means.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "mean")))).scalar()
    moments = counted.withColumn("mean", by_column[F.col("column_name")]).groupBy("column_name").agg(
        F.sum(copies).alias("value_count"), F.first("mean").alias("mean"),
        F.sqrt(F.sum(copies * F.pow(x - F.col("mean"), 2)) / F.nullif(F.sum(copies) - 1, F.lit(0))).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    return moments.join(exact_quantiles(counted, ["column_name"], "x", QUARTILES, "copies"), "column_name")


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed on both sides; empty bins are listed.

    Mean and exact median of the column stand beside each bin.
    """
    x, copies = F.col("x"), F.col("copies")
    counted = (rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x"))
               .agg(F.count(F.lit(1)).alias("copies")))
    edges = counted.agg(F.struct(F.min(x).alias("low"), F.max(x).alias("high"),
                                 (F.sum(x * copies) / F.sum(copies)).alias("mean"))).scalar()
    median = exact_quantiles(counted, [], "x", {"median": 0.5}, "copies").scalar()
    low, span = edges["low"], edges["high"] - edges["low"]
    slot = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - low) * bins / F.nullif(span, F.lit(0.0))), F.lit(bins - 1)))
    counts = counted.groupBy(slot.cast("long").alias("bin")).agg(F.sum(copies).alias("bin_count"))
    frame = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    # The right side holds at most one row per bin.
    return frame.join(F.broadcast(counts), "bin", "left").select(
        "bin", (low + span * F.col("bin") / bins).alias("bin_from"),
        (low + span * (F.col("bin") + 1) / bins).alias("bin_to"),
        F.coalesce("bin_count", F.lit(0)).alias("bin_count"), edges["mean"].alias("mean"), median.alias("median"))


def box_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 quartile ranges, mean, size and outlier count per group; NULLs left out.

    Everything after the first step works on (group, value, count) rows.
    """
    counted = (rows.where(F.col(value).isNotNull())
               .groupBy(group, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("copies")))
    quartiles = exact_quantiles(counted, [group], "x", QUARTILES, "copies")
    # One entry per label, looked up in place of a join.
    by_label = quartiles.agg(F.map_from_entries(F.collect_list(F.struct(group, F.struct(*QUARTILES))))).scalar()
    placed = counted.withColumn("box", by_label[F.col(group)]).select(group, "x", "copies", "box.*")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    return placed.groupBy(group).agg(
        F.sum("copies").alias("n"), (F.sum(F.col("x") * F.col("copies")) / F.sum("copies")).alias("mean"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("copies"))), F.lit(0)).alias("outliers"))
