"""Exact order statistics of large groups: quantiles, and the cut-off of a smallest-k selection.

Quantiles read the wanted ranks off running totals over the sorted distinct values. The cut-off finds the bucket that
holds it from bucket counts, then orders only that bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazardlens.operators.running import running_totals


def _with_bucket_ends(sizes: DataFrame, within: list[str], bucket: str) -> DataFrame:
    """Add the rank just after each bucket and the group total; one row per bucket comes in."""
    upto = W.partitionBy(*within).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (sizes.withColumn("_end", F.sum("_size").over(upto))
            .withColumn("_total", F.sum("_size").over(W.partitionBy(*within))))


def exact_quantiles(rows: DataFrame, within: list[str], value: str, shares: dict[str, float],
                    copies: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles of a numeric column, NULLs left out.

    One row per group, one column per entry of ``shares``. Groups are few-valued, non-NULL labels;
    without any the result is one row. ``copies`` names a column that says how often a row counts. Repeated
    values are folded first, so a value held by a third of all rows costs one row.
    """
    rows_or_copies = F.sum(copies) if copies else F.count(F.lit(1))
    counted = (rows.where(F.col(value).isNotNull())
               .groupBy(*within, F.col(value).cast("double").alias("_value")).agg(rows_or_copies.alias("_n")))
    ranked = running_totals(counted, "_value", {"_upto": "_n"}, within=tuple(within), wholes={"_total": "_n"})

    def position(share: float) -> Column:
        return (F.col("_total") - 1) * F.lit(share)

    def at(rank: Column) -> Column:
        """The value that holds the zero-based rank."""
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")), F.col("_value")))

    picked = ranked.groupBy(*within).agg(F.max("_total").alias("_total"), *[
        pick.alias(f"{name}{side}") for name, share in shares.items()
        for side, pick in (("-", at(F.floor(position(share)))), ("+", at(F.ceil(position(share)))))])

    def interpolated(name: str, share: float) -> Column:
        low, high = F.col(f"`{name}-`"), F.col(f"`{name}+`")
        return low + (high - low) * (position(share) - F.floor(position(share)))

    return picked.select(*within, *[interpolated(name, share).alias(name) for name, share in shares.items()])


def smallest_share_cut(rows: DataFrame, within: str, order_by: str, bucket: Column, share: float) -> DataFrame:
    """Per group, the value of ``order_by`` that closes its smallest ``share`` of rows, and how many those are.

    ``order_by`` must be unique inside a group. Groups that get no row are left out.
    """
    tagged = rows.select(within, order_by).withColumn("_bucket", bucket)
    sizes = tagged.groupBy(within, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    holder = (_with_bucket_ends(sizes, [within], "_bucket")
              .withColumn("taken", F.round(F.col("_total") * F.lit(share)).cast("long"))
              .where((F.col("taken") <= F.col("_end")) & (F.col("taken") > F.col("_end") - F.col("_size"))))
    inside = W.partitionBy(within).orderBy(order_by)
    return (tagged.join(F.broadcast(holder), [within, "_bucket"])
            .withColumn("_rank", F.col("_end") - F.col("_size") + F.row_number().over(inside))
            .where(F.col("_rank") == F.col("taken"))
            .select(within, F.col(order_by).alias("cut"), "taken"))
