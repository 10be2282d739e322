"""Jobs around the stored models: train and evaluate, predict with what is stored, go on training with feedback.

A model folder holds one MLlib model per risk and the metrics document with the features in their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft import schemas
from undercroft.config import RISKS, RiskConfig
from undercroft.operators import feedback
from undercroft.operators.predictions import latest_rows, open_predictions, replace_open, risk_rows
from undercroft.operators.rows import assign_running_ids
from undercroft.plans import boosting, model
from undercroft.session import stage
from undercroft.sources import documents
from undercroft.sources.tables import read_table, replace_table


def save_models(models: dict[str, GBTClassificationModel], folder: str) -> None:
    for risk, fitted in models.items():
        fitted.write().overwrite().save(f"{folder}/{risk}")


def load_models(folder: str) -> dict[str, GBTClassificationModel]:
    """The stored model of every risk."""
    return {risk: GBTClassificationModel.load(f"{folder}/{risk}") for risk in RISKS}


def train_job(
    split_panel: DataFrame, folder: str, cfg: RiskConfig, settings: model.ModelConfig = model.ModelConfig(),
    extra: DataFrame | None = None,
) -> None:
    """Fits, evaluates on valid and test, chooses thresholds on valid, stores models and the metrics document.

    `split_panel` is the panel with a column split; `extra` are weighted feedback rows for a refit.
    """
    panel = stage(split_panel.filter(F.col("split").isin(*model.SPLITS)), "split-panel")
    names = model.panel_features(panel)
    models = model.fit_models(panel, names, settings, extra)
    save_models(models, folder)
    scored = model.model_scores(panel.filter(F.col("split") != "train"), models, names)
    metrics, thresholds = model.evaluate_splits(model.long_model_scores(scored), cfg)
    counts = panel.agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in model.SPLITS])
    ranking = model.contribution_ranking(models, names, panel.filter(F.col("split") == "valid"))
    document = documents.metrics_document(stage(metrics, "metrics"), thresholds, counts, names, ranking)
    documents.write_document(document, f"{folder}/metrics")


def predict_job(spark: SparkSession, panel: DataFrame, folder: str, warehouse: str, cfg: RiskConfig, now: Column) -> None:
    """Scores the newest row of each object with the stored models and replaces every open prediction.

    A row becomes a prediction from its risk's threshold on: the calibrated one, else the document's, else 0.5.
    """
    doc = documents.read_metrics(spark, f"{folder}/metrics")
    head = doc.select("features").first()
    if head is None:
        raise ValueError(f"no trained models in {folder}")
    scored = model.model_scores(latest_rows(panel), load_models(folder), head["features"])
    base = feedback.base_thresholds(panel, documents.metrics_thresholds(doc, "model"))
    calibrated = read_table(spark, f"{warehouse}/calibration", schemas.CALIBRATION)
    limits = feedback.effective_thresholds(base, calibrated)
    created = open_predictions(risk_rows(scored, lambda r: F.col(f"p_{r}")), limits, cfg).withColumn("created_at", now)
    stored = read_table(spark, f"{warehouse}/predictions", schemas.PREDICTIONS)
    created = created.withColumn("id", F.lit(None).cast("bigint")).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PREDICTIONS if f.name in (*created.columns, "id")])
    numbered = assign_running_ids(created, stored, "id", [F.asc("object_id"), F.asc("risk_type")])
    replace_table(replace_open(stored, numbered, "all").select(*schemas.PREDICTIONS.names), f"{warehouse}/predictions")


@dataclass(frozen=True)
class RetrainConfig:
    """Trees added to the stored models by a retraining."""

    rounds: int = 40
    step: float = 0.02
    depth: int = 5
    min_leaf: int = 20
    seed: int = 42


def retrain_job(
    spark: SparkSession, panel: DataFrame, folder: str, warehouse: str, settings: RetrainConfig = RetrainConfig(),
    period: str = "year", point_in_time: bool = True,
) -> dict[str, tuple[int, int]]:
    """Adds trees to the stored models, fitted to what they leave unexplained of the dispatcher's weighted decisions.

    The features are those known at the decision, or the newest ones. The model that was there stays as `<risk>.prev`;
    a risk without decisions keeps its model. The metrics document tells when, and for each risk how many decisions and
    trees there are now, which is returned as well.
    """
    doc = documents.read_metrics(spark, f"{folder}/metrics")
    head = doc.select("features").first()
    if head is None:
        raise ValueError(f"no trained models in {folder}")
    rows = feedback.weighted_training_set(
        read_table(spark, f"{warehouse}/feedback", schemas.FEEDBACK),
        read_table(spark, f"{warehouse}/predictions", schemas.PREDICTIONS),
        panel.drop("split"), point_in_time=point_in_time, period=period)
    rows = model.with_vector(rows, head["features"]).select("risk_type", "features", F.col("y").cast("double").alias("label"), "weight", "decisions")
    rows = stage(rows, "feedback-rows")
    counts = {r["risk_type"]: r["n"] for r in rows.groupBy("risk_type").agg(F.sum("decisions").alias("n")).collect()}
    todo = [r for r in RISKS if counts.get(r)]

    def add(risk: str) -> tuple[int, int]:
        stored = GBTClassificationModel.load(f"{folder}/{risk}")
        updated = boosting.continue_boosting(
            stored, rows.filter(F.col("risk_type") == risk), settings.rounds, settings.step, settings.depth,
            settings.min_leaf, settings.seed)
        stored.write().overwrite().save(f"{folder}/{risk}.prev")
        updated.write().overwrite().save(f"{folder}/{risk}")
        return counts[risk], len(updated.treeWeights)

    report = model.for_each_risk(spark, todo, add)
    documents.write_document(stage(documents.with_retraining(doc, report), "metrics"), f"{folder}/metrics")
    return report
