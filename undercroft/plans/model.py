"""One boosted-tree classifier per risk, trained, evaluated and refitted with MLlib on the feature panel."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from undercroft.config import RISKS, RiskConfig
from undercroft.functions.scores import persist_score, rule_score
from undercroft.operators import curve
from undercroft.operators.predictions import feature_columns, require_columns
from undercroft.operators.rows import reproducible_sample
from undercroft.plans import boosting
from undercroft.session import shared_folder, stage

# Measures that may be missing. Trees here do not know "missing": a measure gets a value below its range and a flag,
# a count gets 0.
MEASURES = (
    "events_per_channel_24h", "temp_mean_6h", "temp_mean_24h", "temp_max_6h", "temp_max_24h", "temp_min_24h",
    "temp_trend", "gas_mean_24h", "gas_max_6h", "gas_max_24h", "temp_out", "precip", "humidity",
)
SENTINEL = -999.0
SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class ModelConfig:
    """Boosting settings. Rounds end where average precision on the valid split was best, once `patience` further ones
    brought nothing better."""

    rounds: int = 500
    step: float = 0.05
    depth: int = 6
    min_leaf: int = 200
    feature_share: str = "0.85"
    row_share: float = 0.8
    patience: int = 40
    seed: int = 42


def year_split(cfg: RiskConfig) -> Column:
    """train / valid / test by the year of a panel row; other years get NULL."""
    year = F.year("hour_ts")
    return (
        F.when(year.isin(*cfg.train_years), "train")
        .when(year.isin(*cfg.valid_years), "valid")
        .when(year.isin(*cfg.test_years), "test")
    )


def model_inputs(features: Sequence[str]) -> list[str]:
    """Columns of the feature vector: the features and a missing flag per measure."""
    return [*features, *[f"{m}_missing" for m in MEASURES if m in features]]


def with_vector(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds the vector `features`; every listed feature must be present."""
    require_columns(panel, features)
    filled = {
        f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL if c in MEASURES else 0.0)) for c in features
    }
    flags = {f"_x_{m}_missing": F.col(m).isNull().cast("double") for m in MEASURES if m in features}
    wide = panel.withColumns({**filled, **flags})
    names = [f"_x_{c}" for c in model_inputs(features)]
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


_T = TypeVar("_T")


def for_each_risk(spark: SparkSession, risks: Sequence[str], work: Callable[[str], _T]) -> dict[str, _T]:
    """The same work for every risk, side by side: small jobs of one model leave room for those of the others."""
    with ThreadPoolExecutor(max_workers=max(1, len(risks))) as pool:
        return dict(zip(risks, pool.map(inheritable_thread_target(spark)(work), risks)))


def _positive_weights(train: DataFrame) -> dict[str, float]:
    """Negatives per positive for each risk: one aggregate, four numbers."""
    row = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y_{r}").alias(r) for r in RISKS]).first()
    return {r: max(row["n"] - (row[r] or 0), 1) / max(row[r] or 0, 1) for r in RISKS}


def fit_models(
    split_panel: DataFrame, features: Sequence[str], settings: ModelConfig = ModelConfig(),
    extra: DataFrame | None = None, risks: Sequence[str] = RISKS,
) -> dict[str, GBTClassificationModel]:
    """Fits each risk on the train split, watched on the valid split.

    `extra` holds weighted rows of the feedback training set (risk_type, y, weight and the panel columns); they join
    the training rows of their risk.
    """
    spark = split_panel.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        # Boosting cuts its own lineage through the same folder.
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    keep = ["split", "features", *[f"y_{r}" for r in RISKS]]
    rows = stage(with_vector(split_panel.filter(F.col("split").isin("train", "valid")), features).select(*keep), "train")
    weights = _positive_weights(rows.filter(F.col("split") == "train"))
    extra_rows = None if extra is None else stage(
        with_vector(extra, features).select("risk_type", "features", "y", "weight"), "feedback"
    )

    def fit(risk: str) -> GBTClassificationModel:
        label = F.col(f"y_{risk}").cast("double")
        data = rows.select(
            "features",
            label.alias("label"),
            F.when(label == 1, F.lit(weights[risk])).otherwise(F.lit(1.0)).alias("weight"),
            (F.col("split") == "valid").alias("is_valid"),
        )
        if extra_rows is not None:
            data = data.unionByName(extra_rows.filter(F.col("risk_type") == risk).select(
                "features", F.col("y").alias("label"), "weight", F.lit(False).alias("is_valid")
            ))
        classifier = GBTClassifier(
            stepSize=settings.step, maxDepth=settings.depth, minInstancesPerNode=settings.min_leaf,
            featureSubsetStrategy=settings.feature_share, subsamplingRate=settings.row_share, seed=settings.seed,
            weightCol="weight")
        return boosting.fit_best_round(classifier, data, settings.rounds, settings.patience)

    return for_each_risk(spark, risks, fit)


def model_scores(rows: DataFrame, models: dict[str, GBTClassificationModel], features: Sequence[str]) -> DataFrame:
    """Adds one probability column `p_<risk>` per model, in one pass over the rows."""
    scored = with_vector(rows, features)
    for risk, model in models.items():
        model = model.copy()
        model.setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred")
        scored = model.transform(scored).withColumn(f"p_{risk}", vector_to_array("_prob")[1])
        scored = scored.drop("_prob", "_raw", "_pred")
    return scored.drop("features")


def long_model_scores(scored: DataFrame) -> DataFrame:
    """Scored panel rows with `split` -> (split, method, risk, y, score) for persist, rules and the model."""
    rows = [
        F.struct(F.lit(m).alias("method"), F.lit(r).alias("risk"), F.col(f"y_{r}").cast("int").alias("y"), s.alias("score"))
        for r in RISKS
        for m, s in (("persist", persist_score(r)), ("rules", rule_score(r)), ("model", F.col(f"p_{r}")))
    ]
    return scored.select("split", "object_id", "hour_ts", F.inline(F.array(*rows)))


def evaluate_splits(long: DataFrame, cfg: RiskConfig) -> tuple[DataFrame, DataFrame]:
    """(metrics of every split, thresholds per method and risk), thresholds being chosen on the valid split."""
    long = stage(long, "scores")
    points = stage(curve.pr_curve(long), "points")
    chosen = curve.choose_thresholds(points.filter(F.col("split") == "valid"), cfg)
    thresholds = stage(curve.fixed_thresholds(chosen).drop("split"), "thresholds")
    return curve.evaluate(long, points, thresholds), thresholds


def feature_ranking(models: dict[str, GBTClassificationModel], features: Sequence[str], like: DataFrame, top: int = 12) -> DataFrame:
    """(risk, rank, feature, gain): leading features of each model by split gain; a short list per model."""
    names = model_inputs(features)
    rows = []
    for risk, model in models.items():
        gains = sorted(zip(model.featureImportances.toArray().tolist(), names), key=lambda p: (-p[0], p[1]))
        rows += [(risk, i + 1, name, float(gain)) for i, (gain, name) in enumerate(gains[:top])]
    return like.sparkSession.createDataFrame(rows, "risk string, rank int, feature string, gain double")


def contribution_ranking(
    models: dict[str, GBTClassificationModel], features: Sequence[str], rows: DataFrame, sample: int = 8000, top: int = 12
) -> DataFrame:
    """(risk, rank, feature, mean_abs_shap): leading features by their mean absolute contribution to the log odds, over
    `sample` rows of the panel, the same ones on every run."""
    spark = rows.sparkSession
    chosen = reproducible_sample(rows.select("object_id", "hour_ts", *features), ["object_id", "hour_ts"], sample)
    chosen = stage(with_vector(chosen, features).select("features"), "contributions")
    names = model_inputs(features)
    means = for_each_risk(spark, list(models), lambda risk: boosting.mean_contributions(
        chosen, boosting.read_ensemble(spark, models[risk])))
    found = []
    for risk, mean in means.items():
        best = sorted(zip(mean.tolist(), names), key=lambda p: (-p[0], p[1]))[:top]
        found += [(risk, i + 1, name, value) for i, (value, name) in enumerate(best)]
    return spark.createDataFrame(found, "risk string, rank int, feature string, mean_abs_shap double")


def panel_features(panel: DataFrame) -> list[str]:
    return feature_columns(panel, skip=("period", "year", "split"))
