"""Classification metrics as aggregates over (label, score) rows; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.operators.running import running_totals


def _label() -> Column:
    return F.col("label")


def with_prediction(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def _ratio(part: Column, whole: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.coalesce(part / F.nullif(whole, F.lit(0).cast("long")), F.lit(0.0))


def _cell(label: int, prediction: int) -> Column:
    return F.count_if((_label() == label) & (F.col("prediction") == prediction))


def confusion(predicted: DataFrame) -> DataFrame:
    """The four cells of the confusion matrix in one row."""
    return predicted.agg(_cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"),
                         _cell(1, 1).alias("tp"))


def quality(predicted: DataFrame) -> DataFrame:
    """Confusion cells with accuracy, precision, recall, F1 and specificity."""
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    return confusion(predicted).select(
        "tn", "fp", "fn", "tp",
        _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fp).alias("specificity"))


def class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))

    def line(section: str, right: Column, over: Column, missed: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), _ratio(right, right + over).alias("precision"),
                        _ratio(right, right + missed).alias("recall"),
                        _ratio(2 * right, 2 * right + over + missed).alias("f1"), (right + missed).alias("support"))

    lines = confusion(predicted).select(
        line(fixed.NEGATIVE_LABEL, tn, fn, fp).alias("no"), line(fixed.POSITIVE_LABEL, tp, fp, fn).alias("yes"),
        _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"), (tn + fp + fn + tp).alias("rows"))

    def average(section: str, weight_no: Column, weight_yes: Column) -> Column:
        mixed = [(F.col(f"no.{name}") * weight_no + F.col(f"yes.{name}") * weight_yes).alias(name)
                 for name in ("precision", "recall", "f1")]
        return F.struct(F.lit(section).alias("section"), *mixed, F.col("rows").alias("support"))

    half = F.lit(0.5)
    everywhere = F.struct(F.lit("accuracy").alias("section"), F.col("accuracy").alias("precision"),
                          F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"),
                          F.col("rows").alias("support"))
    weighted = average("weighted avg", _ratio(F.col("no.support"), F.col("rows")),
                       _ratio(F.col("yes.support"), F.col("rows")))
    return lines.select(F.inline(F.array("no", "yes", everywhere, average("macro avg", half, half), weighted)))


def _score_totals(scored: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score, at or above it, and in all."""
    counted = scored.groupBy("score").agg(
        F.sum(_label()).cast("long").alias("pos"), F.sum(1 - _label()).cast("long").alias("neg"))
    return running_totals(
        counted, "score", {"pos_above": "pos", "neg_above": "neg"}, descending=True,
        wholes={"all_pos": "pos", "all_neg": "neg"})


def roc_points(scored: DataFrame) -> DataFrame:
    """True and false positive rate at each distinct score used as threshold."""
    return _score_totals(scored).select(
        F.col("score").alias("threshold"), (F.col("pos_above") / F.col("all_pos")).alias("tpr"),
        (F.col("neg_above") / F.col("all_neg")).alias("fpr"))


def precision_recall_points(scored: DataFrame) -> DataFrame:
    return _score_totals(scored).select(
        F.col("score").alias("threshold"),
        (F.col("pos_above") / (F.col("pos_above") + F.col("neg_above"))).alias("precision"),
        (F.col("pos_above") / F.col("all_pos")).alias("recall"))


def threshold_point(scored: DataFrame, threshold: float) -> DataFrame:
    """The precision-recall point whose score is nearest to the threshold."""
    return precision_recall_points(scored).orderBy(
        F.abs(F.col("threshold") - threshold), "threshold").limit(1)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in the right order, ties half.

    Computed from counts per distinct score, so no pair is ever formed.
    """
    negatives_below = F.col("all_neg") - F.col("neg_above") + F.col("neg") / 2
    return _score_totals(scored).agg((F.sum(F.col("pos") * negatives_below) / F.nullif(
        F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def _step(score: Column, low: Column, high: Column, steps: int) -> Column:
    """Number of the last grid threshold that the score reaches; thresholds run evenly from low to high."""
    return F.least(F.floor((score - low) / F.nullif(high - low, F.lit(0.0)) * (steps - 1)),
                   F.lit(steps - 1)).cast("long")


def threshold_table(scored: DataFrame, steps: int = fixed.THRESHOLD_STEPS) -> DataFrame:
    """Mean F1 over folds at each of ``steps`` evenly spaced thresholds.

    Rows are counted per fold and grid step; sums over later steps then give what each threshold
    selects. The work does not grow with the number of thresholds.
    """
    edges = scored.agg(F.struct(F.min("score").alias("low"), F.max("score").alias("high"))).scalar()
    low, high = edges["low"], edges["high"]
    reached = F.coalesce(_step(F.col("score"), low, high, steps), F.lit(0))
    counted = scored.groupBy("fold", reached.alias("step")).agg(
        F.sum(_label()).cast("long").alias("pos"), F.sum(1 - _label()).cast("long").alias("neg"))
    # One entry per grid step, so a fold is one short map.
    by_step = counted.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct(
        "step", F.struct("pos", "neg")))).alias("cells"))

    def selected(name: str) -> Column:
        """Sum over this step and the later ones."""
        zero = F.lit(0).cast("long")
        return F.aggregate(F.sequence(F.col("step"), F.lit(steps - 1).cast("long")), zero,
                           lambda total, step: total + F.coalesce(F.try_element_at("cells", step)[name], zero))

    positives = F.aggregate(F.map_values("cells"), F.lit(0).cast("long"), lambda total, cell: total + cell["pos"])
    joined = by_step.withColumn("all_pos", positives).select(
        "cells", "all_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))).alias("step")
    ).select("step", "all_pos", selected("pos").alias("tp"), selected("neg").alias("fp"))
    f1 = _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos"))
    return joined.groupBy("step").agg(F.avg(f1).alias("mean_f1")).select(
        "step", (low + (high - low) * F.col("step") / (steps - 1)).alias("threshold"), "mean_f1")


def best_threshold(scored: DataFrame, steps: int = fixed.THRESHOLD_STEPS) -> DataFrame:
    """The lowest threshold with the highest mean F1, in one row."""
    table = threshold_table(scored, steps)
    return table.orderBy(F.round("mean_f1", 12).desc(), "step").limit(1)


def report_table(named: dict[str, DataFrame]) -> DataFrame:
    """One-row tables as (section, key, value) lines."""
    def lines(section: str, row: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(name).alias("key"), F.col(f"`{name}`").cast("double").alias("value"))
                          for name in row.columns])
        return row.select(F.lit(section).alias("section"), F.inline(pairs))
    return reduce(DataFrame.unionByName, [lines(section, row) for section, row in named.items()])


def _with_end(points: DataFrame, **values: float) -> DataFrame:
    """Add the point of a threshold that selects nothing; its threshold is NULL."""
    ends = [F.lit(None).cast("double").alias("threshold"), *[F.lit(value).alias(name) for name, value in values.items()]]
    return points.unionByName(points.sparkSession.range(1).select(*ends))


def roc_curve(scored: DataFrame) -> DataFrame:
    """ROC points with the start of the curve."""
    return _with_end(roc_points(scored), tpr=0.0, fpr=0.0)


def precision_recall_curve(scored: DataFrame) -> DataFrame:
    """Precision-recall points with the end of the curve."""
    return _with_end(precision_recall_points(scored), precision=1.0, recall=0.0)
