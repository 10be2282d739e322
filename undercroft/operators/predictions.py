"""Open predictions: emitting them from panel scores and replacing the old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.config import RISKS, RiskConfig
from undercroft.functions import text
from undercroft.operators.rows import first_per_key


def latest_rows(panel: DataFrame) -> DataFrame:
    """The newest panel row of each object."""
    return first_per_key(panel, ["object_id"], [F.desc("hour_ts")])


def risk_rows(latest: DataFrame, score_of) -> DataFrame:
    """Panel rows x four risks with the score column `score_of(risk)` of each."""
    parts = [F.struct(F.lit(r).alias("risk_type"), score_of(r).alias("probability")) for r in RISKS]
    return latest.select("*", F.inline(F.array(*parts)))


def open_predictions(
    scored: DataFrame, thresholds: DataFrame, cfg: RiskConfig, top_features: Column | None = None,
    source: str = "model",
) -> DataFrame:
    """Scores at or above their risk's effective threshold -> open predictions with an explanation.

    `thresholds` holds one row per risk. `top_features` is an array of the model's leading features.
    """
    limits = thresholds.select("risk_type", F.col("threshold").alias("_limit"))
    features = F.array().cast("array<string>") if top_features is None else top_features
    return (
        scored.join(limits, "risk_type")
        .filter(F.col("probability") >= F.col("_limit"))
        .select(
            "object_id",
            F.lit(None).cast("bigint").alias("channel_id"),
            "risk_type",
            "probability",
            F.lit(cfg.horizon_hours).alias("horizon_hours"),
            text.model_explanation(F.col("risk_type"), features).alias("explanation"),
            text.recommendation(F.col("risk_type")).alias("recommendation"),
            F.lit("open").alias("status"),
            F.lit(source).alias("source"),
        )
    )


def above_threshold_counts(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per risk: rows at or above the threshold, and what rules and persistence say of the same rows."""
    limits = thresholds.select("risk_type", F.col("threshold"))
    return (
        scored.join(limits, "risk_type")
        .groupBy("risk_type")
        .agg(
            F.first("threshold").alias("threshold"),
            F.count_if(F.col("probability") >= F.col("threshold")).alias("n_above"),
            F.sum("rule").cast("bigint").alias("n_rules"),
            F.avg("persist").alias("persist_mean"),
        )
    )


def replace_open(
    predictions: DataFrame, created: DataFrame, scope: str = "rules", objects: DataFrame | None = None
) -> DataFrame:
    """The prediction table after a scoring job.

    scope="rules": only open rule predictions are replaced (of `objects` only, when given).
    scope="all": every open prediction is replaced, as the model job does.
    """
    stale = F.col("status") == "open"
    if scope == "rules":
        stale = stale & (F.col("source") == "rules")
    elif scope != "all":
        raise ValueError(f"scope must be rules or all, got {scope!r}")
    stale = F.coalesce(stale, F.lit(False))
    if objects is None:
        kept = predictions.filter(~stale)
    else:
        touched = objects.select("object_id").distinct()
        kept = predictions.filter(~stale).unionByName(
            predictions.filter(stale).join(touched, "object_id", "left_anti").select(*predictions.columns)
        )
    return kept.unionByName(created, allowMissingColumns=True)


def filter_predictions(
    predictions: DataFrame, status: str = "open", risk: str | None = None, object_id: int | None = None,
    source: str | None = None,
) -> DataFrame:
    out = predictions
    if status != "all":
        out = out.filter(F.col("status") == status)
    if risk:
        out = out.filter(F.col("risk_type") == risk)
    if object_id is not None:
        out = out.filter(F.col("object_id") == object_id)
    if source:
        out = out.filter(F.col("source") == source)
    return out


def with_object_names(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Adds object_name (NULL when the object is unknown) and the risk's title."""
    names = objects.select(F.col("id").alias("object_id"), F.col("name").alias("object_name"))
    return rows.join(names, "object_id", "left").withColumn("risk_title", text.risk_title(F.col("risk_type")))


def feature_columns(panel: DataFrame, skip: Sequence[str] = ("period",)) -> list[str]:
    """All panel columns but ids and labels."""
    from undercroft.config import ID_COLUMNS, LABEL_COLUMNS

    return [c for c in panel.columns if c not in {*ID_COLUMNS, *LABEL_COLUMNS, *skip}]


def require_columns(frame: DataFrame, names: Sequence[str]) -> None:
    """A model may only score frames that have all of its features."""
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
