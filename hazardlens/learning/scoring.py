"""Applying a fitted model: batch scoring, its summary, what-if sweeps, the report."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.functions.numbers import percent
from hazardlens.learning.features import feature_table, fill_with_zero
from hazardlens.learning.metrics import class_report, quality, report_table, roc_auc, with_prediction
from hazardlens.learning.training import Classifier, Trained, importance_table, score
from hazardlens.sources.tables import written

WHAT_IF_COUNTS = [0, 1, 3, 5, 10, 15]


def save_model(model: Classifier, path: str) -> None:
    """The pipeline with its preparation stage, the category codes and the threshold, in place of what was there.

    The codes are written under a new name each time, as the model may have been loaded from this very folder;
    the settings, written last, say which ones count.
    """
    spark = model.categories.sparkSession
    codes = f"categories-{uuid.uuid4().hex}"
    model.categories.write.parquet(f"{path}/{codes}")
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    settings = spark.createDataFrame([(float(model.threshold), codes)], "threshold double, categories string")
    settings.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> Classifier:
    settings = spark.read.parquet(f"{path}/settings").first()
    return Classifier(PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/{settings['categories']}"),
                      settings["threshold"])


def predict(model: Classifier, packages: DataFrame, threshold: float | None = None,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Label, confidence and both probabilities per package; missing numbers count as zero.

    The threshold is the model's own unless one is given.
    """
    threshold = model.threshold if threshold is None else threshold
    scored = score(model, fill_with_zero(feature_table(packages, target=False, keep=keep)))
    return scored.select(
        "package_name", *keep,
        F.when(F.col("score") >= threshold, fixed.POSITIVE_LABEL).otherwise(fixed.NEGATIVE_LABEL).alias("prediction"),
        F.greatest(F.col("score"), 1 - F.col("score")).alias("confidence"),
        F.col("score").alias("probability_vulnerable"), (1 - F.col("score")).alias("probability_safe"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    vulnerable = F.count_if(F.col("prediction") == fixed.POSITIVE_LABEL)
    rows = F.count(F.lit(1))
    return predictions.agg(
        rows.alias("packages"), vulnerable.alias("predicted_vulnerable"), (rows - vulnerable).alias("predicted_safe"),
        percent(vulnerable, rows, 1).alias("vulnerable_percent"),
        F.avg("confidence").alias("mean_confidence"), F.avg("probability_vulnerable").alias("mean_risk"))


def what_if_grid(packages: DataFrame, counts: list[int] = WHAT_IF_COUNTS) -> DataFrame:
    """Each package once per vulnerability count, with the columns that follow from the count."""
    count = F.col("vulnerability_count")
    return (packages.drop("vulnerability_count", "high_severity_count", "max_severity_score")
            .withColumn("vulnerability_count", F.explode(F.array(*[F.lit(n).cast("long") for n in counts])))
            .withColumn("high_severity_count", F.floor(count / 3))
            .withColumn("max_severity_score", F.least(F.lit(7.0) + count * 0.3, F.lit(10.0))))


def what_if(model: Classifier, packages: DataFrame, threshold: float | None = None) -> DataFrame:
    kept = ("vulnerability_count", "high_severity_count", "max_severity_score")
    return predict(model, what_if_grid(packages), threshold, kept)


def model_report(trained: Trained, table: DataFrame) -> DataFrame:
    """All figures of the training report as (section, key, value) lines."""
    scores = written(score(trained.model, table).select("part", "label", "score"), "scores")
    parts = {part: with_prediction(scores.where(F.col("part") == part), trained.threshold)
             for part in ("train", "test")}
    sections = {
        f"training set: {trained.name}": quality(parts["train"]).select("accuracy"),
        "testing set": quality(parts["test"]).withColumn("threshold", F.lit(trained.threshold)),
        "testing set ranking": roc_auc(parts["test"]),
    }
    by_class = class_report(parts["test"]).select(
        F.concat(F.lit("class: "), "section").alias("section"),
        F.inline(F.array(*[F.struct(F.lit(name).alias("key"), F.col(name).cast("double").alias("value"))
                           for name in ("precision", "recall", "f1", "support")])))
    features = importance_table(table, trained.model).select(
        F.lit("feature importance").alias("section"), F.col("feature").alias("key"),
        F.col("importance").alias("value"))
    return report_table(sections).unionByName(by_class).unionByName(features)
