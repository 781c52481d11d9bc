"""Features, training, metrics and scoring.

Metrics are checked on a score that any engine can compute. Jobs that fit a model return what must hold of
their full outputs, which the library's functions give.
"""

from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.catalog.combining import judged
from hazardlens.catalog.registry import query
from hazardlens.learning import features, metrics, scoring, training
from hazardlens.session import new_folder
from hazardlens.sources.tables import written

_FEATURES = ", ".join(["package_name", *fixed.NUMERIC_FEATURES, "repository_status", *fixed.BOOLEAN_FEATURES, "label"])


def _features(t):
    return features.feature_table(t.risk)


query("m_1_feature_table", f"SELECT {_FEATURES} FROM features")(_features)

query("m_2_category_codes", """
SELECT package_name, dense_rank() OVER (ORDER BY repository_status) - 1 AS category_index FROM features""")(
    lambda t: features.category_codes(_features(t)).select("package_name", "category_index"))

query("m_3_median_filled", "SELECT package_name, " + ", ".join(
    f"COALESCE({name}, (SELECT quantile_cont({name}, 0.5) FROM features)) AS {name}" for name in fixed.NUMERIC_FEATURES)
    + " FROM features")(
    lambda t: features.fill_with_medians(_features(t)).select("package_name", *fixed.NUMERIC_FEATURES))

query("m_4_zero_filled", "SELECT package_name, " + ", ".join(
    f"COALESCE({name}, 0) AS {name}" for name in fixed.NUMERIC_FEATURES) + " FROM features")(
    lambda t: features.fill_with_zero(_features(t)).select("package_name", *fixed.NUMERIC_FEATURES))

_SPLIT = """
WITH placed AS (SELECT package_name, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat(package_name, '|split|42')), package_name) AS rn,
 COUNT(*) OVER (PARTITION BY label) AS n FROM features),
parted AS (SELECT package_name, label, CASE WHEN rn <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM placed) """

query("m_5_stratified_split", _SPLIT + "SELECT * FROM parted")(
    lambda t: features.split(_features(t)).select("package_name", "label", "part"))

query("m_6_split_report", _SPLIT + """
SELECT part, label, COUNT(*) AS rows, round(100.0::DOUBLE * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY part), 1) AS share
FROM parted GROUP BY part, label""")(lambda t: features.split_report(features.split(_features(t))))


def _scaled(t):
    parted = features.split(features.fill_with_zero(_features(t)))
    return features.standardize(parted, parted.where("part = 'train'"))


query("m_7_standardized", _SPLIT + ", filled AS (SELECT f.package_name, part, " + ", ".join(
    f"COALESCE(f.{name}, 0) AS {name}" for name in fixed.NUMERIC_FEATURES)
    + " FROM features f JOIN parted USING (package_name)), fitted AS (SELECT " + ", ".join(
    f"AVG({name}) AS {name}_m, stddev_pop({name}) AS {name}_d" for name in fixed.NUMERIC_FEATURES)
    + " FROM filled WHERE part = 'train') SELECT package_name, " + ", ".join(
    f"round(({name} - {name}_m) / {name}_d, 6) AS {name}" for name in fixed.NUMERIC_FEATURES)
    + " FROM filled, fitted")(
    lambda t: _scaled(t).select("package_name", *[F.round(name, 6).alias(name) for name in fixed.NUMERIC_FEATURES]))

query("m_8_class_weights", """
SELECT COUNT(*) / (2.0::DOUBLE * COUNT(*) FILTER (WHERE label = 0)) AS negative_weight,
 COUNT(*) / (2.0::DOUBLE * COUNT(*) FILTER (WHERE label = 1)) AS positive_weight,
 COUNT(*) FILTER (WHERE label = 0) / (COUNT(*) FILTER (WHERE label = 1))::DOUBLE AS negatives_per_positive, COUNT(*) AS rows
FROM features""")(lambda t: features.class_weights(_features(t)))


def _fitted(t, name):
    """A model of the given kind fitted on the training part, and the table it came from."""
    table = training.training_table(t.risk)
    preparation = features.learn_preparation(table)
    return training.fit(name, table.where("part = 'train'"), preparation), table


def _checked_scores(t, name):
    """Per label of the test part: rows, and whether all scores lie inside (0, 1) and a second fit repeats them."""
    model, table = _fitted(t, name)
    test = table.where("part = 'test'")
    again = training.fit(name, table.where("part = 'train'"), features.learn_preparation(table))
    second = training.score(again, test).select("package_name", F.col("score").alias("second"))
    return training.score(model, test).join(second, "package_name").groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and((F.col("score") >= 0) & (F.col("score") <= 1)).alias("in_range"),
        F.bool_and(F.abs(F.col("score") - F.col("second")) < 1e-9).alias("repeats"))


for _place, _name in ((9, "Logistic Regression"), (10, "Random Forest"), (11, "Boosted Trees")):
    query(f"m_{_place}_{_name.lower().replace(' ', '_')}", _SPLIT + """
SELECT label, COUNT(*) AS rows, TRUE AS in_range, TRUE AS repeats FROM parted WHERE part = 'test' GROUP BY label""")(
        lambda t, name=_name: _checked_scores(t, name))

query("m_12_best_threshold", """
WITH j AS (SELECT score, label, CAST(concat('0x', substr(md5(concat(package_name, '|fold|42')), 1, 8)) AS BIGINT) % 5 AS fold FROM judged),
e AS (SELECT MIN(score) AS lo, MAX(score) AS hi FROM j),
k AS (SELECT fold, label, least(floor((score - lo) / (hi - lo) * 99), 99) AS step FROM j, e),
g AS (SELECT i AS step, fold, SUM(label) FILTER (WHERE k.step >= i) AS tp, COUNT(*) FILTER (WHERE k.step >= i AND label = 0) AS fp,
 SUM(label) AS pos FROM range(100) AS r(i), k GROUP BY i, fold),
m AS (SELECT step, AVG(COALESCE(2.0::DOUBLE * COALESCE(tp, 0) / NULLIF(COALESCE(tp, 0) + fp + pos, 0), 0)) AS mean_f1 FROM g GROUP BY step)
SELECT step, lo + (hi - lo) * step / 99 AS threshold, round(mean_f1, 12) AS mean_f1 FROM m, e ORDER BY round(mean_f1, 12) DESC, step LIMIT 1""")(
    lambda t: metrics.best_threshold(features.with_fold(judged(t))).withColumn("mean_f1", F.round("mean_f1", 12)))


def _chosen(t):
    """The chosen model and all that were tuned."""
    return training.tune_best(training.training_table(t.risk))


def _checked_choice(t):
    """One row per kind of model: whether it was tuned inside [0, 1], and whether the choice has the best fold F1."""
    best, trained = _chosen(t)
    top = max(one.fold_f1 for one in trained)
    rows = [(one.name, 0 <= one.threshold <= 1 and 0 <= one.fold_f1 <= 1, sum(o is best for o in trained) == 1
             and best.fold_f1 == top) for one in trained]
    return t.spark.createDataFrame(rows, "model string, in_range boolean, best_is_chosen boolean")


query("m_13_best_model", """
SELECT unnest(['Logistic Regression', 'Random Forest', 'Boosted Trees']) AS model, TRUE AS in_range, TRUE AS best_is_chosen""")(
    _checked_choice)

_PREDICTED = "SELECT label, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS prediction FROM judged"
_CELLS = f"""
WITH k AS ({_PREDICTED}), cells AS (SELECT COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
 COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
 COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM k) """


def _predicted(t, threshold=0.3):
    return metrics.with_prediction(judged(t), threshold)


query("m_14_confusion_and_quality", _CELLS + """
SELECT tn, fp, fn, tp, (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS accuracy, tp::DOUBLE / (tp + fp) AS precision,
 tp::DOUBLE / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1, tn::DOUBLE / (tn + fp) AS specificity FROM cells""")(
    lambda t: metrics.quality(_predicted(t)))

query("m_15_class_report", _CELLS + """
, lines AS (SELECT 'No Vulnerability' AS section, tn::DOUBLE / (tn + fn) AS precision, tn::DOUBLE / (tn + fp) AS recall,
 2.0::DOUBLE * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM cells UNION ALL
 SELECT 'High-Severity Vulnerability', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), 2.0::DOUBLE * tp / (2 * tp + fp + fn), tp + fn FROM cells)
SELECT section, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
SELECT * FROM lines UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS a, tn + fp + fn + tp AS n FROM cells)
UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support)::BIGINT FROM lines
UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
 SUM(f1 * support) / SUM(support), SUM(support)::BIGINT FROM lines)""")(lambda t: metrics.class_report(_predicted(t)).withColumns(
        {name: F.round(name, 9) for name in ("precision", "recall", "f1")}))

query("m_16_roc_auc", """
WITH k AS (SELECT label, rank() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS place FROM judged)
SELECT round((SUM(place) FILTER (WHERE label = 1) - SUM(label) * (SUM(label) + 1) / 2.0::DOUBLE) / (SUM(label) * SUM(1 - label)), 9) AS auc FROM k""")(
    lambda t: metrics.roc_auc(judged(t)).select(F.round("auc", 9).alias("auc")))

_CURVE = """
WITH k AS (SELECT score, SUM(label)::DOUBLE AS pos, SUM(1 - label)::DOUBLE AS neg FROM judged GROUP BY score),
m AS (SELECT score AS threshold, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS p, SUM(neg) OVER () AS n
FROM k WINDOW w AS (ORDER BY score DESC)) """

query("m_17_roc_curve", _CURVE + """
SELECT threshold, tp / p AS tpr, fp / n AS fpr FROM m UNION ALL SELECT NULL, 0, 0""")(
    lambda t: metrics.roc_curve(judged(t)))

query("m_17_precision_recall_curve", _CURVE + """
SELECT threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM m UNION ALL SELECT NULL, 1, 0""")(
    lambda t: metrics.precision_recall_curve(judged(t)))

query("m_18_fixed_threshold", """
SELECT package_name, CASE WHEN score >= 0.05 THEN 1 ELSE 0 END AS prediction FROM judged""")(
    lambda t: metrics.with_prediction(judged(t), fixed.SAFETY_THRESHOLD).select("package_name", "prediction"))


def _importance(t):
    model, table = _fitted(t, "Random Forest")
    weights = training.importance_table(table, model)
    return weights.agg(F.count(F.lit(1)).alias("features"), F.count_if(F.col("importance") < 0).alias("negative"),
                       (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"))


query("m_19_feature_importance", "SELECT 11 AS features, 0 AS negative, TRUE AS sum_is_one")(_importance)


def _saved_and_loaded(t):
    """Rows of the test part, and whether scores and labels survive saving with a threshold other than 0.5."""
    model, table = _fitted(t, "Logistic Regression")
    folder = new_folder(t.spark, "model")
    scoring.save_model(training.Classifier(model.pipeline, model.categories, 0.7), folder)
    again = scoring.load_model(t.spark, folder)
    test = table.where("part = 'test'")
    kept = training.score(model, test).select("package_name", F.col("score").alias("before"))
    both = training.score(again, test).join(kept, "package_name")
    threshold = F.lit(again.threshold)
    return both.agg(
        F.count(F.lit(1)).alias("rows"), (F.max(F.abs(F.col("score") - F.col("before"))) < 1e-12).alias("same_scores"),
        F.bool_and((F.col("score") >= threshold) == (F.col("before") >= 0.7)).alias("same_labels"))


query("m_20_saved_model", _SPLIT + """
SELECT COUNT(*) AS rows, TRUE AS same_scores, TRUE AS same_labels FROM parted WHERE part = 'test'""")(_saved_and_loaded)


def _predictions(t):
    return scoring.predict(_fitted(t, "Logistic Regression")[0], t.risk, 0.4)


def _consistent(predictions, threshold, *keys):
    """Keys with what must hold between label, confidence and the two probabilities."""
    high, safe = F.col("probability_vulnerable"), F.col("probability_safe")
    label = F.when(high >= threshold, fixed.POSITIVE_LABEL).otherwise(fixed.NEGATIVE_LABEL)
    return predictions.select(*keys, (F.col("prediction") == label).alias("label_fits"),
                              (F.abs(high + safe - 1) < 1e-12).alias("sum_is_one"),
                              (F.col("confidence") == F.greatest(high, safe)).alias("confidence_is_greatest"))


query("m_21_batch_scoring", """
SELECT package_name, TRUE AS label_fits, TRUE AS sum_is_one, TRUE AS confidence_is_greatest FROM r""")(
    lambda t: _consistent(_predictions(t), 0.4, "package_name"))


def _summary_checks(t):
    predictions = written(_predictions(t), "predictions")
    line, rows = scoring.prediction_summary(predictions), F.count(F.lit(1))
    plain = predictions.agg(rows.alias("n"), F.count_if(F.col("probability_vulnerable") >= 0.4).alias("high"),
                            F.avg("confidence").alias("c"), F.avg("probability_vulnerable").alias("p")).select(
        F.struct("*")).scalar()
    return line.select(
        "packages", (F.col("predicted_vulnerable") == plain["high"]).alias("vulnerable_fits"),
        (F.col("predicted_safe") == plain["n"] - plain["high"]).alias("safe_fits"),
        (F.col("vulnerable_percent") == F.round(100.0 * plain["high"] / plain["n"], 1)).alias("percent_fits"),
        ((F.abs(F.col("mean_confidence") - plain["c"]) < 1e-12) & (F.abs(F.col("mean_risk") - plain["p"]) < 1e-12)).alias("means_fit"))


query("m_22_scoring_summary", """
SELECT COUNT(*) AS packages, TRUE AS vulnerable_fits, TRUE AS safe_fits, TRUE AS percent_fits, TRUE AS means_fit FROM r""")(_summary_checks)

query("m_23_what_if_sweep", """
SELECT package_name, n AS vulnerability_count, n // 3 AS high_severity_count, round(least(7.0 + n * 0.3, 10.0)::DOUBLE, 6) AS max_severity_score,
 TRUE AS label_fits, TRUE AS sum_is_one, TRUE AS confidence_is_greatest
FROM r, (SELECT CAST(unnest([0, 1, 3, 5, 10, 15]) AS BIGINT) AS n)""")(lambda t: _consistent(
        scoring.what_if(_fitted(t, "Logistic Regression")[0], t.risk, 0.4), 0.4, "package_name", "vulnerability_count",
        "high_severity_count", F.round("max_severity_score", 6).alias("max_severity_score")))


def _report_checks(t):
    """Lines per section of the report, and whether the test figures follow from one another."""
    table = training.training_table(t.risk)
    trained = training.tune("Logistic Regression", table, features.learn_preparation(table))
    lines = written(scoring.model_report(trained, table), "report")
    figure = {(row["section"], row["key"]): row["value"] for row in lines.where("section LIKE 'testing set%'").collect()}
    tn, fp, fn, tp = (figure["testing set", key] for key in ("tn", "fp", "fn", "tp"))
    want = {"accuracy": (tn + tp) / (tn + fp + fn + tp), "precision": tp / max(tp + fp, 1), "recall": tp / max(tp + fn, 1),
            "specificity": tn / max(tn + fp, 1), "f1": 2 * tp / max(2 * tp + fp + fn, 1), "threshold": trained.threshold}
    fits = all(abs(figure["testing set", key] - value) < 1e-6 for key, value in want.items())
    return lines.groupBy("section").agg(F.count(F.lit(1)).alias("lines")).withColumns(
        {"rows": F.lit(int(tn + fp + fn + tp)), "figures_fit": F.lit(fits)})


query("m_24_model_report", _SPLIT + """
SELECT section, lines, (SELECT COUNT(*) FROM parted WHERE part = 'test') AS rows, TRUE AS figures_fit FROM (VALUES
 ('training set: Logistic Regression', 1), ('testing set', 10), ('testing set ranking', 1), ('class: No Vulnerability', 4),
 ('class: High-Severity Vulnerability', 4), ('class: accuracy', 4), ('class: macro avg', 4), ('class: weighted avg', 4),
 ('feature importance', 11)) v(section, lines)""")(_report_checks)
