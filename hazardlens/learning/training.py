"""Training: three kinds of model, threshold tuning over folds, choice of the best, importance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.learning.features import (Preparation, class_weights, coded, feature_table, learn_preparation, split,
                                          with_fold)
from hazardlens.learning.forest import RandomForest, RandomForestModel
from hazardlens.learning.metrics import best_threshold
from hazardlens.sources.tables import written


def _logistic_regression(rows: int) -> LogisticRegression:
    """Ridge strength 1 on the summed loss, which is 1 / rows on Spark's mean loss."""
    return LogisticRegression(maxIter=1000, regParam=1.0 / max(rows, 1), standardization=False)


#: Trees of the forest grow as deep as those of Spark's own forest may.
FOREST_DEPTH = 30


def _random_forest(rows: int, depth: int = FOREST_DEPTH) -> RandomForest:
    return RandomForest(numTrees=100, maxDepth=depth, seed=fixed.SEED)


def _boosted_trees(rows: int) -> GBTClassifier:
    return GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.3, seed=fixed.SEED)


# Name -> estimator for a number of training rows.
CANDIDATES: dict[str, Callable] = {
    "Logistic Regression": _logistic_regression,
    "Random Forest": _random_forest,
    "Boosted Trees": _boosted_trees,
}


@dataclass(frozen=True)
class Classifier:
    """A fitted pipeline, the category codes it was fitted with, and the threshold that turns a score into a label."""

    pipeline: PipelineModel
    categories: DataFrame
    threshold: float = 0.5

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.pipeline.transform(coded(rows, self.categories))


@dataclass(frozen=True)
class Trained:
    name: str
    model: Classifier
    fold_f1: float | None

    @property
    def threshold(self) -> float:
        return self.model.threshold


def training_table(risk: DataFrame) -> DataFrame:
    """Features with part and fold, written once: every fit reads this table and not the jobs behind it.

    The features are written ahead of the split as well, because the split reads them three times.
    """
    features = written(feature_table(risk), "features")
    return written(with_fold(split(features)), "training")


def fit(name: str, train: DataFrame, preparation: Preparation, threshold: float = 0.5) -> Classifier:
    """One fit on all given rows, classes weighted so that both count the same overall."""
    weights = class_weights(train).first()
    if name == "Boosted Trees":
        positive, negative = weights["negatives_per_positive"], 1.0
    else:
        positive, negative = weights["positive_weight"] or 1.0, weights["negative_weight"] or 1.0
    weighted = coded(train, preparation.categories).withColumn("weight", F.when(F.col("label") == 1, F.lit(positive)).otherwise(F.lit(negative)))
    estimator = CANDIDATES[name](weights["rows"]).setFeaturesCol("features").setLabelCol("label").setWeightCol("weight")
    assembler = VectorAssembler(inputCols=Preparation.inputs(), outputCol="features")
    pipeline = Pipeline(stages=[preparation.stage(), assembler, estimator]).fit(weighted)
    return Classifier(pipeline, preparation.categories, threshold)


def score(model: Classifier, rows: DataFrame) -> DataFrame:
    """The given rows with ``score``, the probability of the positive class."""
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def out_of_fold(name: str, train: DataFrame, preparation: Preparation, folds: int = fixed.FOLDS,
                parallelism: int = fixed.FOLDS) -> DataFrame:
    """Each training row scored by the model that did not see its fold, written once for the tuning to read."""
    def one(fold: int) -> DataFrame:
        model = fit(name, train.where(F.col("fold") != fold), preparation)
        return score(model, train.where(F.col("fold") == fold)).select("package_name", "fold", "label", "score")
    with ThreadPool(parallelism) as pool:
        parts = pool.map(one, range(folds))
    return written(reduce(DataFrame.unionByName, parts), "fold-scores")


def tune(name: str, table: DataFrame, preparation: Preparation) -> Trained:
    """Threshold with the best mean F1 over the folds, and a model fitted on the whole training part.

    That fit takes no part in the threshold, so it runs beside those of the folds.
    """
    train = table.where("part = 'train'")
    with ThreadPool(1) as pool:
        whole = pool.apply_async(fit, (name, train, preparation))
        best = best_threshold(out_of_fold(name, train, preparation)).first()
        model = whole.get()
    return Trained(name, replace(model, threshold=best["threshold"]), best["mean_f1"])


def tune_best(table: DataFrame, names: list[str] | None = None) -> tuple[Trained, list[Trained]]:
    """All candidates tuned, and the one with the highest out-of-fold F1."""
    preparation = learn_preparation(table)
    trained = [tune(name, table, preparation) for name in names or CANDIDATES]
    return max(trained, key=lambda one: one.fold_f1), trained


def importance(model: Classifier) -> list[tuple[str, float]]:
    """(feature, weight) of the fitted estimator; one entry per feature."""
    estimator = model.pipeline.stages[-1]
    if isinstance(estimator, RandomForestModel):
        weights = estimator.importances
    else:
        weights = (estimator.coefficients if hasattr(estimator, "coefficients") else estimator.featureImportances).toArray()
    names = fixed.NUMERIC_FEATURES + [fixed.CATEGORY_FEATURE] + fixed.BOOLEAN_FEATURES
    return [(name, float(weight)) for name, weight in zip(names, weights)]


def importance_table(table: DataFrame, model: Classifier, size: int = 20) -> DataFrame:
    """Features by absolute weight with the direction they push in."""
    rows = table.sparkSession.createDataFrame(importance(model), "feature string, importance double")
    direction = F.when(F.col("importance") > 0, "(+) increases risk").otherwise("(-) decreases risk")
    return (rows.withColumn("direction", direction)
            .orderBy(F.abs("importance").desc(), "feature").limit(size))
