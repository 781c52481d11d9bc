import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.learning import features, forest, metrics, scoring, training
from hazardlens.session import new_folder


@pytest.fixture(scope="module")
def risk(spark):
    draw = random.Random(11)
    lines = []
    for n in range(400):
        stars = draw.randint(0, 2000)
        high = draw.random() < 0.1 + 0.6 * stars / 2000
        lines.append((f"pkg-{n}", stars if n % 9 else None, stars // 4, draw.randint(0, 50), draw.randint(0, 90),
                      draw.randint(0, 500), draw.randint(0, 25), draw.choice(["Active", "Unmaintained", "", None]),
                      draw.randint(1, 40), draw.randint(0, 900), draw.random() < 0.8, draw.random() < 0.2, high))
    return spark.createDataFrame(lines, "package_name string, stars long, forks long, contributions_count long, "
                                 "dependent_repos_count long, dependents_count long, rank long, repository_status string, "
                                 "versions_count long, days_since_last_release long, has_repository boolean, "
                                 "is_unmaintained boolean, has_high_severity_vulnerability boolean")


@pytest.fixture(scope="module")
def table(risk):
    return training.training_table(risk)


@pytest.fixture(scope="module")
def scored(spark):
    draw = random.Random(12)
    lines = [(f"p{n}", n % 5, int(draw.random() < 0.3), round(draw.random(), 2)) for n in range(500)]
    return spark.createDataFrame(lines, "package_name string, fold int, label int, score double")


def test_split_takes_the_share_of_each_class(table):
    for row in features.split_report(table).collect():
        total = table.where(F.col("label") == row["label"]).count()
        if row["part"] == "test":
            assert row["rows"] == round(total * 0.2)


def test_split_is_repeatable_and_depends_on_the_seed(risk):
    table = features.feature_table(risk)

    def test_names(seed):
        return {row[0] for row in features.split(table, seed=seed).where("part = 'test'").select("package_name").collect()}
    assert test_names(1) == test_names(1) != test_names(2)


def test_medians_and_codes(risk):
    table = features.feature_table(risk)
    stars = [row[0] for row in table.select("stars").collect() if row[0] is not None]
    assert features.medians(table, ["stars"]).first()["stars"] == np.median(stars)
    codes = {row["repository_status"]: row["category_index"] for row in features.category_codes(table).collect()}
    assert codes == {"Active": 0, "Unknown": 1, "Unmaintained": 2}


def test_scaling(risk):
    filled = features.fill_with_medians(features.feature_table(risk))
    scaled = features.standardize(filled, filled).agg(F.avg("stars"), F.stddev_pop("stars")).first()
    assert scaled[0] == pytest.approx(0, abs=1e-9) and scaled[1] == pytest.approx(1)


def test_auc_agrees_with_pairs(scored):
    lines = [(row["label"], row["score"]) for row in scored.collect()]
    good = [score for label, score in lines if label]
    bad = [score for label, score in lines if not label]
    pairs = sum((p > n) + (p == n) / 2 for p in good for n in bad)
    assert metrics.roc_auc(scored).first()["auc"] == pytest.approx(pairs / len(good) / len(bad))


def test_curves(scored):
    lines = [(row["label"], row["score"]) for row in scored.collect()]
    positives = sum(label for label, _ in lines)
    for point in metrics.roc_points(scored).collect():
        tp = sum(label for label, score in lines if score >= point["threshold"])
        assert point["tpr"] == pytest.approx(tp / positives)
    assert metrics.roc_curve(scored).where("threshold IS NULL").first()["tpr"] == 0
    near = metrics.threshold_point(scored, 0.051).first()
    assert near["threshold"] == 0.05


def test_threshold_agrees_with_brute_force(scored):
    lines = [(row["fold"], row["label"], row["score"]) for row in scored.collect()]
    low, high = min(line[2] for line in lines), max(line[2] for line in lines)
    table = sorted(metrics.threshold_table(scored, 11).collect())
    assert [row["step"] for row in table] == list(range(11))
    for row in table:
        f1 = []
        for fold in range(5):
            step = [(label, min(int(np.floor((score - low) / (high - low) * 10)), 10)) for f, label, score in lines if f == fold]
            tp = sum(label for label, s in step if s >= row["step"])
            fp = sum(1 - label for label, s in step if s >= row["step"])
            f1.append(2 * tp / (tp + fp + sum(label for label, _ in step)))
        assert row["mean_f1"] == pytest.approx(np.mean(f1))
    best = metrics.best_threshold(scored).first()
    assert low <= best["threshold"] <= high


def test_quality(scored):
    line = metrics.quality(metrics.with_prediction(scored, 0.5)).first()
    assert line["tn"] + line["fp"] + line["fn"] + line["tp"] == 500
    report = {row["section"]: row for row in metrics.class_report(metrics.with_prediction(scored, 0.5)).collect()}
    assert report[fixed.POSITIVE_LABEL]["recall"] == pytest.approx(line["recall"])
    assert report["weighted avg"]["recall"] == pytest.approx(report["accuracy"]["recall"])
    nothing = metrics.quality(metrics.with_prediction(scored, 2.0)).first()
    assert (nothing["precision"], nothing["f1"]) == (0.0, 0.0)


@pytest.fixture(scope="module")
def model(table):
    return training.fit("Logistic Regression", table.where("part = 'train'"), features.learn_preparation(table))


def test_logistic_regression_solves_the_balanced_ridge_problem(table, model):
    """At the solution the gradient of the summed, class-weighted loss with ridge strength 1 vanishes."""
    train = model.transform(table.where("part = 'train'")).select("features", "label").collect()
    x = np.array([row["features"].toArray() for row in train])
    y = np.array([row["label"] for row in train])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    fitted = model.pipeline.stages[-1]
    beta = fitted.coefficients.toArray()
    error = weight * (1 / (1 + np.exp(-(x @ beta + fitted.intercept))) - y)
    assert np.abs(x.T @ error + beta).max() < 0.05 and abs(error.sum()) < 0.05


def test_model_ranks_better_than_chance_and_repeats(table, model):
    test = training.score(model, table.where("part = 'test'"))
    again = training.fit("Logistic Regression", table.where("part = 'train'"), features.learn_preparation(table))
    assert metrics.roc_auc(training.score(model, table.where("part = 'train'"))).first()["auc"] > 0.6
    first = {row["package_name"]: row["score"] for row in test.collect()}
    second = {row["package_name"]: row["score"] for row in training.score(again, table.where("part = 'test'")).collect()}
    assert first == pytest.approx(second)


def test_saved_model_gives_the_same_scores(spark, table, model, risk):
    folder = new_folder(spark, "model")
    scoring.save_model(model, folder)
    scoring.save_model(model, folder)
    before = {row["package_name"]: row["probability_vulnerable"] for row in scoring.predict(model, risk).collect()}
    after = {row["package_name"]: row["probability_vulnerable"] for row in scoring.predict(scoring.load_model(spark, folder), risk).collect()}
    assert before == after and len(before) == 400


def test_threshold_is_saved_and_applied(spark, model, risk):
    folder = new_folder(spark, "model")
    scoring.save_model(training.Classifier(model.pipeline, model.categories, 0.93), folder)
    again = scoring.load_model(spark, folder)
    labels = {row["package_name"]: row["prediction"] for row in scoring.predict(again, risk).collect()}
    strict = {row["package_name"]: row["prediction"] for row in scoring.predict(model, risk, 0.93).collect()}
    assert again.threshold == 0.93 and labels == strict
    assert labels != {row["package_name"]: row["prediction"] for row in scoring.predict(model, risk).collect()}
    scoring.save_model(again, folder)
    assert scoring.load_model(spark, folder).categories.count() == 3


def test_many_categories(spark, risk, monkeypatch):
    from hazardlens.operators import keys

    many = spark.range(20_000).selectExpr("concat('c', lpad(id, 6, '0')) AS repository_status", "id")
    for most in (100, 100_000):
        monkeypatch.setattr(keys, "BROADCAST_ROWS", most)
        assert features.category_codes(many).where("category_index <> id").count() == 0


def test_unseen_category_is_scored_as_the_first(model, risk):
    odd = risk.limit(5).withColumn("repository_status", F.lit("Never seen' \\ before"))
    first = odd.withColumn("repository_status", F.lit("Active"))
    assert scoring.predict(model, odd).collect() == scoring.predict(model, first).collect()


def test_predictions_summary_and_sweep(model, risk):
    predictions = scoring.predict(model, risk)
    line = predictions.agg(F.min("confidence"), F.max(F.abs(F.col("probability_vulnerable") + F.col("probability_safe") - 1))).first()
    assert line[0] >= 0.5 and line[1] < 1e-9
    summary = scoring.prediction_summary(predictions).first()
    assert summary["packages"] == summary["predicted_vulnerable"] + summary["predicted_safe"] == 400
    base = risk.limit(2).withColumns({name: F.lit(0) for name in ("vulnerability_count", "high_severity_count", "max_severity_score")})
    sweep = scoring.what_if(model, base)
    found = sorted({(row["vulnerability_count"], row["high_severity_count"], round(row["max_severity_score"], 1)) for row in sweep.collect()})
    assert found == [(0, 0, 7.0), (1, 0, 7.3), (3, 1, 7.9), (5, 1, 8.5), (10, 3, 10.0), (15, 5, 10.0)]


def test_tuning_and_report(table):
    best, trained = training.tune_best(table, ["Logistic Regression"])
    assert best is trained[0] and 0 <= best.threshold <= 1
    lines = {(row["section"], row["key"]) for row in scoring.model_report(best, table).collect()}
    assert ("testing set", "f1") in lines and ("testing set ranking", "auc") in lines
    assert {key for section, key in lines if section == "feature importance"} == set(
        fixed.NUMERIC_FEATURES + ["repository_status"] + fixed.BOOLEAN_FEATURES)


@pytest.mark.parametrize("name", ["Random Forest", "Boosted Trees"])
def test_tree_models_fit(table, name, monkeypatch):
    small = training.CANDIDATES[name]
    monkeypatch.setitem(training.CANDIDATES, name, lambda rows: (
        small(rows).setNumTrees(5) if name == "Random Forest" else small(rows).setMaxIter(3)).setMaxDepth(3))
    fitted = training.fit(name, table.where("part = 'train'"), features.learn_preparation(table))
    test = training.score(fitted, table.where("part = 'test'"))
    assert 0 <= metrics.roc_auc(test).first()["auc"] <= 1
    assert training.importance_table(table, fitted).count() == 11


def _forest(table, trees=7, **settings):
    estimator = forest.RandomForest(numTrees=trees, **settings)
    with pytest.MonkeyPatch.context() as patch:
        patch.setitem(training.CANDIDATES, "Random Forest", lambda rows: estimator)
        return training.fit("Random Forest", table.where("part = 'train'"), features.learn_preparation(table))


def _scores(model, table):
    return {row["package_name"]: row["score"] for row in training.score(model, table).collect()}


@pytest.mark.parametrize("depth", [4, 30])
def test_forest_in_parts_is_the_forest_in_one(table, monkeypatch, depth):
    whole = _forest(table, maxDepth=depth)
    assert whole.pipeline.stages[-1].parts.count() == 7
    monkeypatch.setattr(forest, "PART_ROWS", 30)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    parted = _forest(table.repartition(3), maxDepth=depth)
    # Neither the driver nor a task holds a whole tree.
    assert parted.pipeline.stages[-1].parts.count() > 30
    assert _scores(parted, table) == pytest.approx(_scores(whole, table), abs=1e-12)
    assert dict(training.importance(parted)) == pytest.approx(dict(training.importance(whole)))
    assert sum(weight for _, weight in training.importance(whole)) == pytest.approx(1)


def test_forest_ranks_and_is_saved(spark, table, risk):
    model = _forest(table, trees=40)
    assert metrics.roc_auc(training.score(model, table.where("part = 'train'"))).first()["auc"] > 0.99
    assert metrics.roc_auc(training.score(model, table.where("part = 'test'"))).first()["auc"] > 0.55
    folder = new_folder(spark, "model")
    scoring.save_model(model, folder)
    again = scoring.load_model(spark, folder)
    scoring.save_model(again, folder)
    again = scoring.load_model(spark, folder)
    assert _scores(again, table) == _scores(model, table)
    assert len(scoring.predict(again, risk.limit(0)).collect()) == 0


def test_a_tree_learns_any_rule_of_its_bins():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 6, (3000, 5)).astype(np.uint8)
    label = ((codes[:, 0] + codes[:, 1] * codes[:, 2]) % 3 == 0).astype(np.int32)
    found = forest.grow(codes, label, np.full(3000, 0.5), 0, 1, 30, 1)
    leaf = forest.descend(codes, np.zeros(3000, np.int64), found["feature"], found["bin"], found["left"])
    # Nodes whose features gain nothing stay mixed; nearly all do not.
    assert np.abs(found["share"][leaf] - label).mean() < 0.02
    first = forest.grow(codes, label, np.full(3000, 0.5), 0, 1, 1, 1)
    column = codes[:, first["feature"][0]]

    def impurity(at):
        return sum(2 * len(part) * part.mean() * (1 - part.mean()) for part in (label[column <= at], label[column > at]))
    assert len(first["feature"]) == 3 and first["bin"][0] == min(range(5), key=impurity)


def test_the_whole_part_is_fitted_beside_the_folds(spark, monkeypatch):
    """It waited for all folds, and the slowest fit, of boosted trees, came twice after one another."""
    together = threading.Barrier(fixed.FOLDS + 1)

    def fit(name, train, preparation, threshold=0.5):
        together.wait(60)
        return training.Classifier(None, None, threshold)

    monkeypatch.setattr(training, "fit", fit)
    monkeypatch.setattr(training, "score", lambda model, rows: rows.withColumn("score", F.lit(0.25) + F.col("label") / 2))
    table = spark.createDataFrame([(f"p{i}", "train", i % fixed.FOLDS, i // 7 % 2) for i in range(70)],
                                  "package_name string, part string, fold int, label int")
    tuned = training.tune("any", table, None)
    assert 0.25 < tuned.threshold <= 0.75 and tuned.model.threshold == tuned.threshold and tuned.fold_f1 == 1
