"""Jobs on the dispatcher's tables: rule predictions, decisions with feedback and audit, calibration.

Tables under the warehouse folder: predictions, feedback, audit, calibration. Each job reads the tables it
needs, applies the operators, and replaces or extends the tables that change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft import schemas
from undercroft.config import RiskConfig
from undercroft.operators import feedback
from undercroft.operators.alarm_risk import score_alarms
from undercroft.operators.audit import audit_rows
from undercroft.operators.predictions import replace_open
from undercroft.operators.rows import assign_running_ids, hashed_id
from undercroft.plans import alarm_store
from undercroft.session import stage
from undercroft.sources.tables import read_table, replace_table, write_table


def _table(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    return read_table(spark, f"{warehouse}/{name}", getattr(schemas, name.upper()))


def _like(rows: DataFrame, schema) -> DataFrame:
    """Rows under a table's columns and types; columns they lack are NULL."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def rule_job(
    spark: SparkSession, warehouse: str, channels: DataFrame, cfg: RiskConfig, now: Column, objects: DataFrame | None = None
) -> None:
    """Scores the stored alarms of the horizon and replaces the open rule predictions (of `objects` only, if given)."""
    recent = alarm_store.recent_alarms(spark, warehouse, cfg)
    created = score_alarms(recent, channels, cfg, objects).withColumn("created_at", now)
    stored = _table(spark, warehouse, "predictions")
    numbered = assign_running_ids(
        _like(created, schemas.PREDICTIONS), stored, "id", [F.asc("object_id"), F.asc("risk_type")])
    replace_table(replace_open(stored, _like(numbered, schemas.PREDICTIONS), "rules", objects), f"{warehouse}/predictions")


def decision_job(spark: SparkSession, warehouse: str, decisions: DataFrame) -> DataFrame:
    """Applies decisions: status of the predictions, feedback and audit rows. Returns the rejected ones."""
    decisions = stage(decisions, "decisions")
    predictions = _table(spark, warehouse, "predictions")
    accepted, rejected = feedback.split_decisions(decisions, predictions)
    accepted = stage(accepted, "accepted")
    rows = feedback.feedback_rows(accepted)
    rows = rows.withColumn("id", hashed_id(*[F.col(c) for c in ("prediction_id", "decision", "user_login", "created_at")]))
    write_table(_like(rows, schemas.FEEDBACK), f"{warehouse}/feedback", mode="append")
    entries = audit_rows(accepted, "prediction.decision", F.col("user_login"), F.col("decided_at"), "prediction_id", "decision")
    write_table(_like(entries, schemas.AUDIT), f"{warehouse}/audit", mode="append")
    replace_table(feedback.apply_decisions(predictions, accepted), f"{warehouse}/predictions")
    return rejected


def calibration_job(spark: SparkSession, warehouse: str, known: DataFrame | None = None) -> None:
    """Thresholds from the stored feedback, in place of the last ones."""
    predictions = _table(spark, warehouse, "predictions")
    base = feedback.base_thresholds(predictions, known)
    found = feedback.calibrate(base, _table(spark, warehouse, "feedback"), predictions)
    replace_table(stage(found, "calibrated"), f"{warehouse}/calibration")


def audit_list(spark: SparkSession, warehouse: str, n: int) -> DataFrame:
    """The newest audit rows of the stored table."""
    return _table(spark, warehouse, "audit").orderBy(F.desc("created_at"), F.desc("id")).limit(n)
