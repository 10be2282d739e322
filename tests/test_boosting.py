"""Best rounds, added trees, contributions: against plain Python on small models."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import SMALL, at
from tests.test_model_jobs import SETTINGS, panel_of
from undercroft import schemas
from undercroft.config import RISKS
from undercroft.plans import boosting, model_jobs
from undercroft.session import stage
from undercroft.sources import documents


@pytest.fixture(scope="module")
def rows(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) < 15
    frame = spark.range(1500).select(
        "id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 100).alias("a"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7))).cast("double").alias("b"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(50)) / 10).alias("c"), noise.alias("noise"))
    rule = (F.col("a") + F.col("b") > 9) & (F.col("c") > 1)
    frame = frame.withColumn("label", (rule != F.col("noise")).cast("double")).withColumn("weight", 1 + F.col("c"))
    frame = frame.withColumn("is_valid", F.col("id") % 3 == 0)
    return stage(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame).drop("noise"), "rows")


def classifier(**more):
    return GBTClassifier(**{"maxDepth": 3, "stepSize": 0.3, "weightCol": "weight", "seed": 3, "minInstancesPerNode": 5, **more})


@pytest.fixture(scope="module")
def fitted(rows):
    return classifier(maxIter=6).fit(rows)


def margins(fitted_model, rows):
    return np.array([r[0] for r in fitted_model.transform(rows).orderBy("id").select(vector_to_array("rawPrediction")[1]).collect()])


def matrix(rows):
    return np.array([list(r[0]) for r in rows.orderBy("id").select(vector_to_array("features")).collect()])


def test_trees_are_read_as_they_score(spark, rows, fitted):
    steps = boosting.read_ensemble(spark, fitted).steps(matrix(rows))
    assert np.allclose(steps.sum(axis=0), margins(fitted, rows))
    cut = boosting.first_trees(spark, fitted, 2)
    assert np.allclose(steps[:2].sum(axis=0), margins(cut, rows))
    assert np.allclose(margins(classifier(maxIter=2).fit(rows), rows), margins(cut, rows))


def test_joined_trees_keep_their_numbers(spark, rows, fitted, tmp_path):
    """A model that all rounds stayed in and one that was cut or continued describe a tree alike, also when stored."""
    longer = boosting.continue_boosting(fitted, rows, rounds=1, depth=2)
    for i, made in enumerate((boosting.first_trees(spark, fitted, 6), longer)):
        made.write().save(f"{tmp_path}/{i}")
        stored = GBTClassificationModel.load(f"{tmp_path}/{i}")
        assert (stored.numFeatures, stored.numClasses) == (fitted.numFeatures, fitted.numClasses) == (3, 2)
        assert [t.toDebugString for t in stored.trees[:6]] == [t.toDebugString for t in fitted.trees]


def plain_precision(score, label):
    order = sorted(set(score.tolist()), reverse=True)
    return sum(label[score == s].sum() / label.sum() * label[score >= s].mean() for s in order)


def test_precision_of_every_round(spark, rows, fitted):
    ensemble = boosting.read_ensemble(spark, fitted)
    got = boosting.precision_by_round(rows, ensemble, steps=64)
    label = np.array([r["label"] for r in rows.orderBy("id").collect()])
    reached = np.cumsum(ensemble.steps(matrix(rows)), axis=0)
    want = [plain_precision(np.floor(64 / (1 + np.exp(-2 * m))), label) for m in reached]
    assert np.allclose(got, want)
    assert (boosting.precision_by_round(rows.where("label = 0"), ensemble) == 0).all()
    assert boosting.precision_by_round(rows.limit(0), ensemble).shape == (6,)


def test_best_round_with_patience():
    assert boosting.best_round([0.1, 0.3, 0.2, 0.2, 0.9], 2) == (2, True)
    assert boosting.best_round([0.1, 0.3, 0.2, 0.2, 0.9], 4) == (5, False)
    assert boosting.best_round([0.5, 0.5, 0.5], 2) == (1, True)
    assert boosting.best_round([0.1], 40) == (1, False)


def test_the_kept_model_equals_fitting_that_many_rounds(spark, rows):
    kept = boosting.fit_best_round(classifier(), rows, most=24, patience=4)
    n = len(kept.treeWeights)
    assert 1 <= n < 24
    again = classifier(maxIter=n).fit(rows.where("not is_valid"))
    assert np.allclose(margins(kept, rows), margins(again, rows))
    whole = boosting.precision_by_round(rows.where("is_valid"), boosting.read_ensemble(spark, classifier(maxIter=n + 4).fit(rows.where("not is_valid"))))
    assert whole.argmax() + 1 == n
    # Nothing to compare rounds by: all of them stay.
    assert len(boosting.fit_best_round(classifier(), rows.where("not is_valid"), most=5, patience=2).treeWeights) == 5


def test_added_trees_lower_the_loss_and_leave_the_first_alone(spark, rows, fitted, tmp_path):
    # Decisions that contradict the model: everything with c above 3 was a false alarm.
    decided = stage(rows.where("c > 2").withColumn("label", (F.col("c") <= 3).cast("double")).withColumn("weight", F.lit(2.0)), "decided")
    updated = boosting.continue_boosting(fitted, decided, rounds=10, step=0.1, depth=2)
    updated.write().overwrite().save(str(tmp_path / "m"))
    updated = GBTClassificationModel.load(str(tmp_path / "m"))
    before, after = (boosting.read_ensemble(spark, m) for m in (fitted, updated))
    assert after.weights.tolist() == [*before.weights.tolist(), *[0.1] * 10]
    for old, new in zip(before.trees, after.trees):
        assert all(np.array_equal(getattr(old, f), getattr(new, f)) for f in ("feature", "limit", "left", "right", "value", "cover"))
    assert boosting.log_loss(updated, decided) < 0.9 * boosting.log_loss(fitted, decided)
    # The first added tree is the least-squares tree of the log loss's gradient.
    x, label = matrix(decided), np.array([r["label"] for r in decided.orderBy("id").collect()])
    y, m = 2 * label - 1, margins(fitted, decided)
    residual = 4 * y / (1 + np.exp(2 * y * m))
    tree = after.trees[len(before.trees)]
    leaf = tree.leaves(x)
    for node in set(leaf.tolist()):
        assert math.isclose(tree.value[node], residual[leaf == node].mean(), rel_tol=1e-9)
    assert boosting.continue_boosting(fitted, decided.limit(0)) is fitted


def known_value(tree, x, known, node=0):
    """Expected value of the tree when only some features are known."""
    f = int(tree.feature[node])
    if f < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return known_value(tree, x, known, left if x[f] <= tree.limit[node] else right)
    return sum(tree.cover[c] / tree.cover[node] * known_value(tree, x, known, c) for c in (left, right))


def test_contributions_are_shapley_values(spark, rows, fitted):
    ensemble = boosting.read_ensemble(spark, fitted)
    x = matrix(rows)[:25]
    got = boosting.contributions(ensemble, x)
    for k, row in enumerate(x):
        worth = {}
        for size in range(4):
            for s in itertools.combinations(range(3), size):
                worth[frozenset(s)] = sum(w * known_value(t, row, s) for w, t in zip(ensemble.weights, ensemble.trees))
        for i in range(3):
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (worth[s | {i}] - worth[s]) for s in worth if i not in s)
            assert math.isclose(got[k, i], want, abs_tol=1e-9)
        assert math.isclose(got[k].sum(), worth[frozenset(range(3))] - worth[frozenset()], abs_tol=1e-9)
    assert boosting.adds_up(rows, ensemble)
    mean = boosting.mean_contributions(rows.where("id < 25"), ensemble)
    assert np.allclose(mean, np.abs(2 * boosting.contributions(ensemble, matrix(rows.where("id < 25")))).mean(axis=0))


def test_retrain_job_starts_from_the_stored_models(spark, tmp_path):
    folder, house = str(tmp_path / "models"), str(tmp_path / "house")
    panel = panel_of(spark).withColumns(
        {c: F.lit(0.0) for c in ("pump_on_24h", "precip", "chatter_max_24h", "intrusion_channels_6h")})
    model_jobs.train_job(panel, folder, SMALL, SETTINGS)
    before = model_jobs.load_models(folder)
    head = documents.read_metrics(spark, f"{folder}/metrics").first()
    assert all(head["shap"][r][0]["feature"] == "ev_24h" and head["shap"][r][0]["mean_abs_shap"] > 0 for r in RISKS)
    preds = [(i, i % 20, None, ("fire", "flood")[i % 2], 0.5, 24, "why", "do", "open", "rules", at(0)) for i in range(40)]
    given = [(i, i, "false_alarm" if i % 4 < 2 else "dispatch", None, "u", at(5000)) for i in range(40)]
    spark.createDataFrame(preds, schemas.PREDICTIONS).write.parquet(f"{house}/predictions")
    spark.createDataFrame(given, schemas.FEEDBACK).write.parquet(f"{house}/feedback")
    settings = model_jobs.RetrainConfig(rounds=3, step=0.1, depth=2, min_leaf=1)
    report = model_jobs.retrain_job(spark, panel, folder, house, settings)
    trees = {r: len(before[r].treeWeights) for r in RISKS}
    assert report == {r: (20, trees[r] + 3) for r in ("fire", "flood")}
    after = model_jobs.load_models(folder)
    assert {r: len(m.treeWeights) for r, m in after.items()} == {r: trees[r] + 3 * (r in report) for r in RISKS}
    assert len(GBTClassificationModel.load(f"{folder}/fire.prev").treeWeights) == trees["fire"]
    doc = documents.read_metrics(spark, f"{folder}/metrics").first()
    assert doc["retrain"]["fire"]["n"] == 20 and doc["retrained_at"] and doc["features"] == head["features"]
    assert doc["thresholds"] == head["thresholds"]
    with pytest.raises(ValueError, match="no trained models"):
        model_jobs.retrain_job(spark, panel, str(tmp_path / "none"), house)
