"""Precision-recall curve, average precision, thresholds and metrics for any number of (split, method, risk) keys.

Input is a long frame with the key columns, a 0/1 label `y` and a `score`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.config import RISKS, RiskConfig
from undercroft.functions.scores import persist_score, rule_score
from undercroft.operators.rows import running_totals

KEYS = ("split", "method", "risk")


def long_scores(panel: DataFrame, methods: Sequence[str] = ("persist", "rules"), split: str = "all") -> DataFrame:
    """Panel rows -> one row per (method, risk) with label and score, in one pass over the panel."""
    score = {"persist": persist_score, "rules": rule_score}
    rows = [
        F.struct(
            F.lit(split).alias("split"), F.lit(m).alias("method"), F.lit(r).alias("risk"),
            F.col(f"y_{r}").cast("int").alias("y"), score[m](r).alias("score"),
        )
        for m in methods
        for r in RISKS
    ]
    return panel.select("object_id", "hour_ts", F.inline(F.array(*rows)))


def pr_curve(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per distinct score: precision and recall when everything at or above it is predicted positive."""
    cells = scores.groupBy(*keys, "score").agg(
        F.sum("y").cast("bigint").alias("pos"), F.count(F.lit(1)).alias("n")
    )
    summed = running_totals(cells, keys, [F.desc("score")], {"tp": F.col("pos"), "predicted": F.col("n")}, "curve")
    totals = summed.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("n").alias("n_rows"))
    return summed.join(totals, list(keys)).select(
        *keys,
        F.col("score").alias("threshold"),
        "pos",
        "tp",
        "predicted",
        "n_pos",
        "n_rows",
        (F.col("tp") / F.col("predicted")).alias("precision"),
        # With no positive rows every recall is 1 by convention.
        F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(F.lit(1.0)).alias("recall"),
    )


def average_precision(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Step-wise area: each score's own recall gain times its precision; 0 for one-class labels.

    The recall gain of a score is its own positives over all positives, so no neighbour is needed.
    """
    step = F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)) * F.col("precision")
    one_class = (F.max("n_pos") == 0) | (F.max("n_pos") == F.max("n_rows"))
    return curve.groupBy(*keys).agg(
        F.when(one_class, F.lit(0.0)).otherwise(F.sum(step)).alias("pr_auc")
    )


def targets_frame(curve: DataFrame, cfg: RiskConfig) -> DataFrame:
    """The goals as a small table: one row per risk."""
    rows = [(r, t.min_precision, t.min_recall, t.strategy) for r, t in cfg.targets.items()]
    return curve.sparkSession.createDataFrame(
        rows, "risk string, min_precision double, min_recall double, strategy string"
    )


def choose_thresholds(curve: DataFrame, cfg: RiskConfig, keys: Sequence[str] = KEYS) -> DataFrame:
    """Best threshold per key by its risk's strategy; ties go to the lowest threshold.

    recall_first: best precision among points that reach the recall goal, else the point of best recall.
    precision_first: best recall among points that reach the precision goal, else the point of best precision.
    """
    points = curve.join(F.broadcast(targets_frame(curve, cfg)), "risk")
    first = F.col("strategy") == "recall_first"
    met = F.when(first, F.col("recall") >= F.col("min_recall")).otherwise(F.col("precision") >= F.col("min_precision"))
    # With the goal met the other metric is maximised; without it, the goal's own metric.
    aim = F.when(first == met, F.col("precision")).otherwise(F.col("recall"))
    return points.groupBy(*keys).agg(
        F.max_by(
            "threshold", F.struct(met.alias("met"), aim.alias("aim"), (-F.col("threshold")).alias("low"))
        ).alias("threshold")
    )


def fixed_thresholds(chosen: DataFrame, methods: Sequence[str] = ("rules",), value: float = 0.5) -> DataFrame:
    """Rule scores are already decisions: their threshold is fixed."""
    return chosen.withColumn("threshold", F.when(F.col("method").isin(*methods), value).otherwise(F.col("threshold")))


def metrics_at_threshold(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Precision, recall and counts at each key's threshold (a few rows, hence broadcast); 0 on division by zero."""
    on = [k for k in thresholds.columns if k in keys]
    hit = F.col("score") >= F.col("threshold")
    agg = (
        scores.join(thresholds, on)
        .groupBy(*keys)
        .agg(
            F.first("threshold").alias("threshold"),
            F.count_if(hit & (F.col("y") == 1)).alias("_tp"),
            F.count_if(hit).alias("positives_pred"),
            F.sum("y").cast("bigint").alias("positives_true"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    zero = F.lit(0.0)
    return agg.select(
        *keys,
        "threshold",
        F.coalesce(F.col("_tp") / F.nullif(F.col("positives_pred"), F.lit(0)), zero).alias("precision"),
        F.coalesce(F.col("_tp") / F.nullif(F.col("positives_true"), F.lit(0)), zero).alias("recall"),
        "positives_pred",
        "positives_true",
        "n",
    )


def evaluate(scores: DataFrame, curve: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Metrics at threshold together with the area under the curve."""
    return metrics_at_threshold(scores, thresholds, keys).join(
        average_precision(curve, keys), list(keys)
    )


def comparison_table(metrics: DataFrame, cfg: RiskConfig, model: str = "model") -> DataFrame:
    """persist / rules / model by risk, whether the model meets its goals and whether it beats persistence.

    All inputs hold one row per (method, risk).
    """
    persist = metrics.filter(F.col("method") == "persist").select("risk", F.col("pr_auc").alias("persist_pr_auc"))
    goals = targets_frame(metrics, cfg)
    is_model = F.col("method") == model
    met = (F.col("precision") >= F.col("min_precision")) & (F.col("recall") >= F.col("min_recall"))
    return (
        metrics.join(F.broadcast(goals), "risk")
        .join(F.broadcast(persist), "risk", "left")
        .select(
            "risk", "method", "precision", "recall", "pr_auc", "threshold", "min_precision", "min_recall",
            F.when(is_model, met).alias("goal_met"),
            F.when(is_model, F.when(F.col("pr_auc") >= F.col("persist_pr_auc"), "OK").otherwise("WEAK")).alias("verdict"),
        )
    )
