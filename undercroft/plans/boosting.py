"""Boosted trees beyond the fit: the best round, trees added to a stored model, contributions of features.

Trees of MLlib are read from the form in which a model is stored, as a few arrays a tree; their size is bounded by rounds
and depth, so they are shared with all tasks. Rows are never collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.session import fresh_path, stage

#: Steps of the score in which average precision is measured while rounds are compared.
STEPS = 4096
#: Rounds whose scores a task adds up at a time.
BLOCK = 64
#: Rounds after which the margins of a continued fit are written, so that plans stay short.
WRITE_EVERY = 8


@dataclass(frozen=True)
class Tree:
    """Nodes by number: the feature of an inner node (-1: leaf), its limit, its children, value and weight of rows."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            low = x[inner, self.feature[node]] <= self.limit[node]
            at[inner] = np.where(low, self.left[node], self.right[node])


@dataclass(frozen=True)
class Ensemble:
    trees: tuple[Tree, ...]
    weights: np.ndarray

    def steps(self, x: np.ndarray) -> np.ndarray:
        """What each tree adds to the margin of each row."""
        return np.array([w * t.value[t.leaves(x)] for w, t in zip(self.weights, self.trees)]).reshape(len(self.trees), len(x))


def read_ensemble(spark: SparkSession, model: GBTClassificationModel) -> Ensemble:
    """The trees of a fitted or loaded model."""
    folder = fresh_path(spark, "trees")
    model.write().overwrite().save(folder)
    rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    nodes: dict[int, list] = {}
    for row in rows:
        nodes.setdefault(row["treeID"], []).append(row)
    trees = []
    for _, group in sorted(nodes.items()):
        number = {row["id"]: i for i, row in enumerate(group)}
        inner = [row["leftChild"] >= 0 for row in group]
        if any(i and row["split"]["numCategories"] != -1 for i, row in zip(inner, group)):
            raise ValueError("splits by category are not read")
        pick = lambda of, other, kind: np.array(
            [of(row) if i else other for i, row in zip(inner, group)], dtype=kind)
        trees.append(Tree(
            pick(lambda r: r["split"]["featureIndex"], -1, np.int64),
            pick(lambda r: r["split"]["leftCategoriesOrThreshold"][0], 0.0, float),
            pick(lambda r: number[r["leftChild"]], -1, np.int64), pick(lambda r: number[r["rightChild"]], -1, np.int64),
            np.array([r["prediction"] for r in group]), np.array([r["impurityStats"][0] for r in group])))
    return Ensemble(tuple(trees), np.array(model.treeWeights))


def join_trees(spark: SparkSession, trees: Sequence, weights: Sequence[float], like: GBTClassificationModel) -> GBTClassificationModel:
    """A model of the given (JVM) trees, with the columns, thresholds and numbers of features and classes of `like`."""
    jvm, gateway = spark._jvm, spark._sc._gateway
    array = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    numbers = gateway.new_array(jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        array[i], numbers[i] = tree, float(weight)
    made = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        like.uid, array, numbers, like.numFeatures, like.numClasses))
    for column in ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
        made.set(made.getParam(column), like.getOrDefault(like.getParam(column)))
    return made


def first_trees(spark: SparkSession, model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model as it was after n rounds."""
    trees = model._java_obj.trees()
    return join_trees(spark, [trees[i] for i in range(n)], model.treeWeights[:n], model)


def precision_by_round(rows: DataFrame, ensemble: Ensemble, steps: int = STEPS) -> np.ndarray:
    """Average precision of (features, label) after each round, in one pass over the rows.

    Scores fall into `steps` equal steps of the probability; tasks count rows and positives of each round and step, so
    what is shuffled and collected depends on rounds and steps alone.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(ensemble)  # rounds * 2 ** depth nodes
    n_rounds = len(ensemble.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        counts = np.zeros((n_rounds, steps, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist(), dtype=float)
            label = batch.column(1).to_numpy() > 0
            margin = np.zeros(len(x))
            for start in range(0, n_rounds, BLOCK):
                part = Ensemble(trees.trees[start:start + BLOCK], trees.weights[start:start + BLOCK])
                margins = margin + np.cumsum(part.steps(x), axis=0)
                margin = margins[-1]
                at = np.minimum(steps - 1, (steps / (1 + np.exp(-2 * margins))).astype(np.int64))
                for i, found in enumerate(at):
                    counts[start + i, :, 0] += np.bincount(found, minlength=steps)
                    counts[start + i, :, 1] += np.bincount(found[label], minlength=steps)
        round_, step = np.nonzero(counts[:, :, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(round_, pa.int32()), pa.array(step, pa.int32()), *(pa.array(counts[round_, step, i]) for i in (0, 1))],
            ["round", "step", "n", "pos"])

    counted = rows.select(vector_to_array("features"), F.col("label").cast("double")).mapInArrow(
        run, "round int, step int, n long, pos long")
    cells = counted.groupBy("round", "step").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    n, pos = (np.zeros((n_rounds, steps)) for _ in range(2))
    for row in cells.collect():
        # The highest step first.
        n[row["round"], steps - 1 - row["step"]], pos[row["round"], steps - 1 - row["step"]] = row["n"], row["pos"]
    total = pos.sum(axis=1)
    precision = np.cumsum(pos, axis=1) / np.maximum(np.cumsum(n, axis=1), 1)
    return np.where(total > 0, (pos * precision).sum(axis=1) / np.maximum(total, 1), 0.0)


def best_round(precision: Sequence[float], patience: int) -> tuple[int, bool]:
    """(number of rounds to keep, whether `patience` rounds after it brought nothing better)."""
    best = int(np.argmax(precision)) + 1
    for i in range(1, len(precision) + 1):
        top = int(np.argmax(precision[:i])) + 1
        if i - top >= patience:
            return top, True
    return best, False


def fit_best_round(classifier: GBTClassifier, rows: DataFrame, most: int, patience: int) -> GBTClassificationModel:
    """Fits on the rows that are not `is_valid`, and keeps the rounds up to the best one on those that are.

    Rounds are doubled until `patience` of them brought no better average precision, or `most` are reached: no more than
    about twice the rounds that were needed are fitted. Without a valid row of each class all `most` rounds stay.
    """
    spark = rows.sparkSession
    train, valid = rows.where(~F.col("is_valid")), rows.where("is_valid")
    judged = valid.agg(F.count_distinct("label").alias("n")).first()["n"] == 2
    rounds = min(most, max(2 * patience, 1)) if judged else most
    while True:
        model = classifier.copy({classifier.maxIter: rounds}).fit(train)
        if not judged:
            return model
        keep, settled = best_round(precision_by_round(valid, read_ensemble(spark, model)), patience)
        if settled or rounds >= most:
            return first_trees(spark, model, keep)
        rounds = min(most, 2 * rounds)


def continue_boosting(
    model: GBTClassificationModel, rows: DataFrame, rounds: int = 40, step: float = 0.02, depth: int = 5,
    min_leaf: int = 1, seed: int = 42,
) -> GBTClassificationModel:
    """The stored model with `rounds` further trees, fitted to what it leaves unexplained on `rows`.

    `rows` has features, label (0 or 1) and weight. Each tree is fitted to the gradient of the log loss at the margins
    reached so far and joins with the weight `step`; the model's own trees stay as they are. Without rows the model is
    returned unchanged.
    """
    spark = rows.sparkSession
    known = model.copy().setRawPredictionCol("_raw").setProbabilityCol("_prob").setPredictionCol("_pred").transform(rows)
    # The label's sign and the margin as MLlib's log loss has them.
    state = stage(known.select("features", (2 * F.col("label") - 1).alias("y"), "weight",
                               vector_to_array("_raw")[1].alias("margin")), "boost")
    if state.isEmpty():
        return model
    learner = DecisionTreeRegressor(labelCol="residual", weightCol="weight", maxDepth=depth, minInstancesPerNode=min_leaf,
                                    predictionCol="step")
    added = []
    for i in range(rounds):
        residual = 4 * F.col("y") / (1 + F.exp(2 * F.col("y") * F.col("margin")))
        tree = learner.copy({learner.seed: seed + i}).fit(state.withColumn("residual", residual))
        added.append(tree)
        moved = tree.transform(state).withColumn("margin", F.col("margin") + step * F.col("step"))
        state = moved.select("features", "y", "weight", "margin")
        if (i + 1) % WRITE_EVERY == 0:
            state = stage(state, "boost")
    old = model._java_obj.trees()
    trees = [*(old[i] for i in range(len(model.treeWeights))), *(tree._java_obj for tree in added)]
    return join_trees(spark, trees, [*model.treeWeights, *[step] * rounds], model)


def log_loss(model: GBTClassificationModel, rows: DataFrame) -> float:
    """Weighted log loss of (features, label, weight), as boosting lowers it."""
    known = model.copy().setRawPredictionCol("_raw").setProbabilityCol("_prob").setPredictionCol("_pred").transform(rows)
    against = -2 * (2 * F.col("label") - 1) * vector_to_array("_raw")[1]
    return known.agg(F.sum(F.col("weight") * F.log1p(F.exp(against))).alias("loss")).first()["loss"]


@dataclass(frozen=True)
class _Leaf:
    """A leaf's part in the contributions: conditions of its path merged by feature, and what each pattern of met
    conditions gives to each feature."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray


def _leaves(tree: Tree) -> list[_Leaf]:
    out: list[_Leaf] = []

    def walk(node: int, path: dict[int, tuple[float, float, float]]) -> None:
        f = int(tree.feature[node])
        if f < 0:
            if path:
                out.append(_leaf(path, float(tree.value[node])))
            return
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, a, b in ((tree.left[node], low, min(high, tree.limit[node])), (tree.right[node], max(low, tree.limit[node]), high)):
            walk(int(child), path | {f: (a, b, share * tree.cover[child] / tree.cover[node])})
    walk(0, {})
    return out


def _leaf(path: dict[int, tuple[float, float, float]], value: float) -> _Leaf:
    """Shapley values of the game whose worth for a set of known features is the leaf's value times, for every feature
    of the path, 1 or 0 (met or not) if it is known and its share of the rows if it is not."""
    features = sorted(path)
    m = len(features)
    share = np.array([path[f][2] for f in features])
    table = np.zeros((2 ** m, m))
    order = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    for met in range(2 ** m):
        known = np.array([met >> j & 1 for j in range(m)], dtype=float)
        for i in range(m):
            # by_size[s]: worth of all sets of s other features together.
            by_size = np.zeros(m)
            by_size[0] = 1.0
            for j in range(m):
                if j != i:
                    by_size[1:] = by_size[1:] * share[j] + by_size[:-1] * known[j]
                    by_size[0] *= share[j]
            table[met, i] = value * (known[i] - share[i]) * float(np.dot(order, by_size))
    return _Leaf(np.array(features), np.array([path[f][0] for f in features]), np.array([path[f][1] for f in features]), table)


def contributions(ensemble: Ensemble, x: np.ndarray) -> np.ndarray:
    """Shapley values of the margin for each row and feature, given the shares of training rows at each split."""
    out = np.zeros(x.shape)
    for weight, tree in zip(ensemble.weights, ensemble.trees):
        for leaf in _leaves(tree):
            values = x[:, leaf.features]
            met = ((values > leaf.low) & (values <= leaf.high)) @ (1 << np.arange(len(leaf.features)))
            out[:, leaf.features] += weight * leaf.table[met]
    return out


def mean_contributions(rows: DataFrame, ensemble: Ensemble) -> np.ndarray:
    """Mean absolute contribution of each feature to the log odds over `rows` (features); zeros without rows."""
    shared = rows.sparkSession.sparkContext.broadcast(ensemble)  # rounds * 2 ** depth nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0), 0
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), dtype=float)
                # A margin is half the log odds.
                total = (total if n else np.zeros(x.shape[1])) + np.abs(2 * contributions(shared.value, x)).sum(axis=0)
                n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())],
            ["feature", "total", "n"])

    sums = rows.select(vector_to_array("features")).mapInArrow(run, "feature int, total double, n long")
    found = sums.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("feature").collect()
    return np.array([r["mean"] for r in found])


def adds_up(rows: DataFrame, ensemble: Ensemble, within: float = 1e-6) -> bool:
    """Whether every row's contributions add up to its margin less the mean margin of the trees' own rows."""
    shared = rows.sparkSession.sparkContext.broadcast(ensemble)  # rounds * 2 ** depth nodes

    def mean(tree: Tree) -> float:
        leaf = tree.feature < 0
        return float((tree.value[leaf] * tree.cover[leaf]).sum() / tree.cover[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        base = sum(w * mean(t) for w, t in zip(trees.weights, trees.trees))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), dtype=float)
                gap = np.abs(contributions(trees, x).sum(axis=1) - (trees.steps(x).sum(axis=0) - base)).max()
                yield pa.RecordBatch.from_arrays([pa.array([gap])], ["gap"])

    gaps = rows.select(vector_to_array("features")).mapInArrow(run, "gap double")
    return (gaps.agg(F.max("gap").alias("gap")).first()["gap"] or 0.0) < within
