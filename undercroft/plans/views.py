"""Read queries behind the screens: lists, cards, dashboard, model tables."""

from __future__ import annotations

from collections.abc import Callable

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.config import DECISION_TITLES, RISK_TITLES, RISKS, RiskConfig
from undercroft.functions import text
from undercroft.functions.calendar import FLOOD_MONTHS, HEATING_MONTHS
from undercroft.functions.rules import classify_event
from undercroft.operators import hierarchy
from undercroft.operators.alarm_risk import data_horizon
from undercroft.operators.predictions import filter_predictions, with_object_names

CRITICAL = 0.8


def risk_map(predictions: DataFrame) -> DataFrame:
    """Open predictions per object: a map risk -> count (at most one entry per risk) and the highest probability."""
    per_risk = (
        predictions.filter((F.col("status") == "open") & F.col("object_id").isNotNull())
        .groupBy("object_id", "risk_type")
        .agg(F.count(F.lit(1)).alias("n"), F.max("probability").alias("p"))
    )
    return per_risk.groupBy("object_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("risk_type", "n")))).alias("open_risks"),
        F.greatest(F.max(F.coalesce("p", F.lit(0.0))), F.lit(0.0)).alias("max_probability"),
    )


def object_list(
    objects: DataFrame, predictions: DataFrame, kind: str | None = None, parent_id: int | None = None,
    q: str | None = None, limit: int | None = None, with_risks: bool = True,
) -> DataFrame:
    """Objects by level and id with their open risks; filters and a page's limit apply before the join."""
    rows = objects
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if parent_id is not None:
        rows = rows.filter(F.col("parent_id") == parent_id)
    if q:
        rows = rows.filter(F.col("name").ilike(f"%{q}%"))
    if limit is not None:
        rows = rows.orderBy("level", "id").limit(limit)
    if not with_risks:
        return rows
    empty = F.create_map().cast("map<string,bigint>")
    risks = risk_map(predictions).withColumnRenamed("object_id", "id")
    return (
        rows.join(risks, "id", "left")
        .withColumn("open_risks", F.coalesce("open_risks", empty))
        .withColumn("max_probability", F.nullif(F.col("max_probability"), F.lit(0.0)))
        .orderBy("level", "id")
    )


def object_card(
    objects: DataFrame, channels: DataFrame, predictions: DataFrame, object_id: int, cfg: RiskConfig
) -> dict[str, Callable[[], DataFrame]]:
    """The parts of one object's card, each made when it is called for: climbing the tree writes tables.

    Lists stay frames: an object may own any share of the channels.
    """
    node = objects.filter(F.col("id") == object_id)
    own = channels.filter(F.col("object_id") == object_id)
    pickets = hierarchy.picket_profile(own, cfg)

    def ancestors() -> DataFrame:
        chain = hierarchy.ancestors(objects, node.select(F.col("id").alias("object_id")))
        return hierarchy.root_first(chain).orderBy("position")

    def open_rows() -> DataFrame:
        rows = with_object_names(filter_predictions(predictions, object_id=object_id), objects)
        return rows.orderBy(F.desc("probability"), F.desc("id"))

    return {
        "object": lambda: node.withColumns({
            "n_channels": own.agg(F.count(F.lit(1))).scalar(),
            "n_pickets": pickets.agg(F.count(F.lit(1))).scalar(),
        }),
        "ancestors": ancestors,
        "children": lambda: hierarchy.children(objects).filter(F.col("object_id") == object_id).orderBy("child_id"),
        "pickets": lambda: hierarchy.natural_order(pickets),
        "predictions": open_rows,
    }


def object_channels(channels: DataFrame, object_id: int) -> DataFrame:
    return (
        channels.filter(F.col("object_id") == object_id)
        .select("id", "sensor_type", "system_type", "name", "picket", "tag")
        .orderBy("id")
    )


def event_list(
    alarms: DataFrame, channels: DataFrame, objects: DataFrame, cfg: RiskConfig, object_id: int | None = None,
    channel_id: int | None = None, date_from: dt.datetime | None = None, date_to: dt.datetime | None = None,
    sensor_type: str | None = None, limit: int | None = 50,
) -> DataFrame:
    """Newest alarms with object name and risk. Filters on the alarm itself reach the scan; without filters on the
    channel the limit is taken before any join."""
    rows = alarms
    if channel_id is not None:
        rows = rows.filter(F.col("channel_id") == channel_id)
    if date_from is not None:
        rows = rows.filter(F.col("event_ts") >= F.lit(date_from.isoformat(" ")).cast("timestamp_ntz"))
    if date_to is not None:
        rows = rows.filter(F.col("event_ts") <= F.lit(date_to.isoformat(" ")).cast("timestamp_ntz"))
    order = [F.desc("event_ts"), F.desc("event_id")]
    dims = channels.select(F.col("id").alias("channel_id"), "object_id", "sensor_type", "picket")
    if object_id is not None or sensor_type:
        if object_id is not None:
            dims = dims.filter(F.col("object_id") == object_id)
        if sensor_type:
            dims = dims.filter(F.col("sensor_type") == sensor_type)
        rows = rows.join(dims, "channel_id")
        rows = rows if limit is None else rows.orderBy(*order).limit(limit)
    else:
        rows = rows if limit is None else rows.orderBy(*order).limit(limit)
        rows = rows.join(dims, "channel_id", "left")
    names = objects.select(F.col("id").alias("object_id"), F.col("name").alias("object_name"))
    return rows.join(names, "object_id", "left").select(
        "event_id", "event_ts", "channel_id", "object_id", "object_name", "sensor_type", "picket", "value_raw",
        "value_cat", classify_event(F.col("sensor_type"), F.col("value_cat"), cfg).alias("risk"),
    )


def alarm_journal(alarms: DataFrame, channels: DataFrame, limit: int = 20) -> DataFrame:
    """Newest alarms for export; the value is the status word, else the raw text."""
    dims = channels.select(F.col("id").alias("channel_id"), "object_id", F.col("name").alias("channel"), "sensor_type")
    order = [F.desc("event_ts"), F.desc("event_id")]
    return (
        alarms.orderBy(*order)
        .limit(limit)
        .join(dims, "channel_id", "left")
        .select(
            "event_id", F.col("event_ts").alias("ts"), "object_id", "channel", "sensor_type",
            F.coalesce(F.nullif("value_cat", F.lit("")), "value_raw").alias("value"),
        )
    )


def prediction_list(predictions: DataFrame, objects: DataFrame, limit: int = 100, **filters) -> DataFrame:
    """Predictions by probability, then id, both descending."""
    order = [F.desc("probability"), F.desc("id")]
    rows = filter_predictions(predictions, **filters).orderBy(*order).limit(limit)
    return with_object_names(rows, objects)


def feedback_history(predictions: DataFrame, feedback: DataFrame, prediction_id: int | None = None) -> DataFrame:
    """Feedback of one prediction, newest first; of all predictions, in no order: a reader sorts what it shows."""
    rows = feedback if prediction_id is None else feedback.filter(F.col("prediction_id") == prediction_id)
    known = predictions.select(F.col("id").alias("prediction_id"), "risk_type", "status")
    found = rows.join(known, "prediction_id").withColumn("decision_title", text.lookup(F.col("decision"), DECISION_TITLES)).select(
        "prediction_id", "risk_type", "status", "id", "decision", "decision_title", "reason", "user_login", "created_at")
    return found if prediction_id is None else found.orderBy(F.desc("id"))


def dashboard_totals(predictions: DataFrame, alarms: DataFrame, cfg: RiskConfig) -> DataFrame:
    """One row: open predictions, objects at risk, open per risk (0 when none), alarm window and season."""
    still_open = predictions.filter(F.col("status") == "open")
    totals = still_open.agg(
        F.count(F.lit(1)).alias("open_total"),
        F.count_distinct("object_id").alias("objects_at_risk"),
        *[F.count_if(F.col("risk_type") == r).alias(f"open_{r}") for r in RISKS],
    )
    horizon = data_horizon(alarms, cfg)
    month = F.month("data_to")
    return totals.withColumns({c: horizon.select(c).scalar() for c in ("data_from", "data_to")}).withColumns({
        "month": month,
        "flood_season": F.coalesce(month.isin(*FLOOD_MONTHS), F.lit(False)),
        "heating_season": F.coalesce(month.isin(*HEATING_MONTHS), F.lit(False)),
        "stream_slo_seconds": F.lit(300),
    })


def dashboard_top(predictions: DataFrame, objects: DataFrame, n: int = 15) -> DataFrame:
    """The `n` most probable open predictions; critical ones are marked among these only."""
    top = filter_predictions(predictions).orderBy(F.desc("probability"), F.desc("id")).limit(n)
    return with_object_names(top, objects).withColumn("is_critical", F.col("probability") >= CRITICAL)


def model_table(metrics: DataFrame, effective: DataFrame, calibration: DataFrame) -> DataFrame:
    """Test metrics of the model per risk with calibrated thresholds and feedback counts; every risk is listed.

    All inputs hold one row per risk.
    """
    counts = calibration.select("risk_type", "n_dispatch", "n_false_alarm")
    titles = effective.sparkSession.createDataFrame(list(RISK_TITLES.items()), "risk_type string, title string")
    measured = metrics.withColumnRenamed("risk", "risk_type").select(
        "risk_type", "precision", "recall", "pr_auc", "threshold"
    )
    return (
        titles.join(measured, "risk_type", "left")
        .join(effective.withColumnRenamed("threshold", "calibrated_threshold"), "risk_type", "left")
        .join(counts, "risk_type", "left")
        .fillna(0, ["n_dispatch", "n_false_alarm"])
    )


def ticket_list(tickets: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    rows = tickets.filter(F.col("status") == status) if status else tickets
    return rows.orderBy(F.desc("id")).limit(limit)
