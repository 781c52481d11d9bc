"""Feature table, category codes, missing values, scaling, split and folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions.numbers import truth
from hazardlens.functions.text import or_default
from hazardlens.operators.keys import long_form, with_lookup
from hazardlens.operators.ranks import exact_quantiles, smallest_share_cut
from hazardlens.operators.running import alphabetical


def feature_table(risk: DataFrame, target: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Model inputs per package, and the ``keep`` columns as they are.

    Vulnerability columns are no inputs because they give the target away.
    """
    columns = [F.col(name).cast("double").alias(name) for name in fixed.NUMERIC_FEATURES]
    columns.append(or_default(F.col(fixed.CATEGORY_FEATURE), fixed.UNKNOWN).alias(fixed.CATEGORY_FEATURE))
    columns += [truth(F.col(name)).cast("int").alias(name) for name in fixed.BOOLEAN_FEATURES]
    if target:
        columns.append(truth(F.col(fixed.TARGET)).cast("int").alias("label"))
    return risk.select("package_name", *keep, *columns)


def category_table(features: DataFrame) -> DataFrame:
    """Zero-based alphabetical code of every category, as a stored table."""
    return alphabetical(features, fixed.CATEGORY_FEATURE, "category_code")


def category_codes(features: DataFrame) -> DataFrame:
    """Each row with the code of its category."""
    return coded(features, category_table(features)).withColumnRenamed("category_code", "category_index")


def coded(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``category_code``; a blank category is the unknown one, a category without a code gets 0."""
    known = or_default(F.col(fixed.CATEGORY_FEATURE), fixed.UNKNOWN)
    keyed = rows.withColumn("_category", known)
    codes = categories.select(F.col(fixed.CATEGORY_FEATURE).alias("_category"), "category_code")
    return with_lookup(keyed, codes, "_category").drop("_category").withColumn(
        "category_code", F.coalesce("category_code", F.lit(0).cast("long")))


def medians(features: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median of each column, in one row."""
    values = long_form(features.select(*columns), columns, "column_name", "value")
    middles = exact_quantiles(values, ["column_name"], "value", {"median": 0.5})
    return middles.agg(*[F.max(F.when(F.col("column_name") == name, F.col("median"))).alias(name)
                         for name in columns])


def fill_with_medians(features: DataFrame, columns: list[str] = fixed.NUMERIC_FEATURES) -> DataFrame:
    row = medians(features, columns).select(F.struct(*columns)).scalar()
    return features.withColumns({name: F.coalesce(F.col(name), row[name]) for name in columns})


def fill_with_zero(features: DataFrame, columns: list[str] = fixed.NUMERIC_FEATURES) -> DataFrame:
    return features.fillna(0.0, columns)


def standardize(rows: DataFrame, fitted_on: DataFrame, columns: list[str] = fixed.NUMERIC_FEATURES) -> DataFrame:
    """(x - mean) / population deviation, both taken from ``fitted_on``; a constant column becomes 0."""
    def moments(name: str) -> Column:
        return F.struct(F.avg(name).alias("mean"), F.stddev_pop(name).alias("deviation")).alias(name)
    row = fitted_on.agg(*[moments(name) for name in columns]).select(F.struct(*columns)).scalar()
    return rows.withColumns({
        name: (F.col(name) - row[name]["mean"]) / F.coalesce(F.nullif(row[name]["deviation"], F.lit(0.0)), F.lit(1.0))
        for name in columns})


def _digest(purpose: str, seed: int) -> Column:
    return F.md5(F.concat("package_name", F.lit(f"|{purpose}|{seed}")))


def split(features: DataFrame, share: float = fixed.TEST_SHARE, seed: int = fixed.SEED) -> DataFrame:
    """Add ``part``: exactly ``share`` of each class (rounded) is 'test', the rest 'train'.

    Rows are ordered by a seeded digest of the package name; only the digest bucket that holds the
    cut is ever sorted.
    """
    place = F.concat(_digest("split", seed), "package_name")
    keyed = features.withColumn("_place", place)
    cuts = smallest_share_cut(keyed, "label", "_place", F.substring("_place", 1, 4), share)
    part = F.when(F.col("_place") <= F.col("cut"), F.lit("test")).otherwise(F.lit("train"))
    # One cut per class.
    return keyed.join(F.broadcast(cuts), "label", "left").withColumn("part", part).drop("_place", "cut", "taken")


def with_fold(features: DataFrame, folds: int = fixed.FOLDS, seed: int = fixed.SEED) -> DataFrame:
    head = F.conv(F.substring(_digest("fold", seed), 1, 8), 16, 10).cast("long")
    return features.withColumn("fold", (head % folds).cast("int"))


def split_report(parted: DataFrame) -> DataFrame:
    """Rows per part and class with their share of the part."""
    counts = parted.groupBy("part", "label").agg(F.count(F.lit(1)).alias("rows"))
    # One row per part and class.
    return counts.withColumn("share", F.round(F.lit(100.0) * F.col("rows") / F.sum("rows").over(
        W.partitionBy("part")), 1))


def class_weights(rows: DataFrame) -> DataFrame:
    """Balanced weight of each class, and negatives per positive, in one row."""
    total, positives = F.count(F.lit(1)), F.sum("label")
    negatives = total - positives
    return rows.agg((total / (2 * F.nullif(negatives, F.lit(0)))).alias("negative_weight"),
                    (total / (2 * F.nullif(positives, F.lit(0)))).alias("positive_weight"),
                    F.coalesce(negatives / F.nullif(positives, F.lit(0)), F.lit(1.0)).alias("negatives_per_positive"),
                    total.alias("rows"))


@dataclass(frozen=True)
class Preparation:
    """Everything learned from the data before a model sees it: a few numbers per column, and the category codes."""

    fill: dict[str, float]
    mean: dict[str, float]
    deviation: dict[str, float]
    categories: DataFrame

    def stage(self) -> SQLTransformer:
        """The steps for ``coded`` rows as a pipeline stage that is saved with the model."""
        scaled = [
            f"(coalesce(CAST({name} AS DOUBLE), {self.fill[name]!r}D) - {self.mean[name]!r}D)"
            f" / {self.deviation[name] or 1.0!r}D AS {name}_scaled" for name in fixed.NUMERIC_FEATURES]
        flags = [f"CAST({name} AS DOUBLE) AS {name}_flag" for name in fixed.BOOLEAN_FEATURES]
        code = "CAST(category_code AS DOUBLE) AS category_index"
        return SQLTransformer(statement=f"SELECT *, {', '.join([*scaled, code, *flags])} FROM __THIS__")

    @staticmethod
    def inputs() -> list[str]:
        return ([f"{name}_scaled" for name in fixed.NUMERIC_FEATURES] + ["category_index"]
                + [f"{name}_flag" for name in fixed.BOOLEAN_FEATURES])


def learn_preparation(parted: DataFrame, median_of_train_only: bool = False) -> Preparation:
    """Medians over all rows (or the training part), scaling from the training part, category codes."""
    numeric = fixed.NUMERIC_FEATURES
    train = parted.where("part = 'train'")
    fill = medians(train if median_of_train_only else parted, numeric).first().asDict()
    fill = {name: value if value is not None else 0.0 for name, value in fill.items()}
    filled = train.select(*[F.coalesce(F.col(name), F.lit(fill[name])).alias(name) for name in numeric])
    row = filled.agg(*[F.avg(name).alias(f"{name}_mean") for name in numeric],
                     *[F.stddev_pop(name).alias(f"{name}_deviation") for name in numeric]).first().asDict()
    return Preparation(fill, {name: row[f"{name}_mean"] or 0.0 for name in numeric},
                       {name: row[f"{name}_deviation"] or 0.0 for name in numeric}, category_table(parted))
