"""Rule scoring of the alarm mart over the last day of data time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.config import RiskConfig
from undercroft.functions import scores, text
from undercroft.functions.rules import classify_event
from undercroft.operators.rows import first_per_key

SAMPLES_KEPT = 4


def data_horizon(alarms: DataFrame, cfg: RiskConfig) -> DataFrame:
    """One row: the newest alarm time and the time one horizon before it (data time, not wall clock)."""
    newest = F.max("event_ts")
    return alarms.agg(
        (newest - F.make_dt_interval(hours=F.lit(cfg.horizon_hours))).alias("data_from"), newest.alias("data_to")
    )


def recent_classified_alarms(
    alarms: DataFrame, channels: DataFrame, cfg: RiskConfig, horizon: DataFrame | None = None
) -> DataFrame:
    """Alarms inside the horizon, both ends included, with object, picket and risk; unclassified ones are dropped."""
    horizon = data_horizon(alarms, cfg) if horizon is None else horizon
    start, end = (horizon.select(c).scalar() for c in ("data_from", "data_to"))
    dims = channels.filter(F.col("object_id").isNotNull()).select(
        F.col("id").alias("channel_id"), "object_id", "sensor_type", "picket"
    )
    recent = alarms.filter(F.col("event_ts").between(start, end))
    if "day" in alarms.columns:  # a stored mart: the days of the horizon prune its folders
        recent = recent.filter(F.col("day").between(start.cast("date"), end.cast("date")))
    return (
        recent.join(dims, "channel_id")
        .withColumn("risk_type", classify_event(F.col("sensor_type"), F.col("value_cat"), cfg))
        .filter(F.col("risk_type").isNotNull())
    )


def alarm_risk_buckets(classified: DataFrame) -> DataFrame:
    """Per (object, risk): events, distinct channels, distinct pickets, lowest channel and up to four samples.

    Distinct values are found by grouping on them first, so no set grows inside one task; samples are cut to four
    per bucket before they are collected.
    """
    by_channel = classified.groupBy("object_id", "risk_type", "channel_id", "picket").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = by_channel.groupBy("object_id", "risk_type").agg(
        F.sum("n").alias("n_events"),
        F.count_distinct("channel_id").alias("n_channels"),
        F.count_distinct(F.nullif(F.col("picket"), F.lit(""))).alias("n_pickets"),
        F.min("channel_id").alias("channel_id"),
    )
    label = F.concat(
        F.col("sensor_type"), F.lit("="),
        F.coalesce(F.nullif(F.col("value_cat"), F.lit("")), F.col("value_raw"), F.lit("None")),
        F.lit(" @ "), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm"),
    )
    few = first_per_key(
        classified.select("object_id", "risk_type", "event_ts", "event_id", label.alias("sample")),
        ["object_id", "risk_type"],
        [F.asc("event_ts"), F.asc("event_id")],
        SAMPLES_KEPT,
    )
    samples = few.groupBy("object_id", "risk_type").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("event_ts", "event_id", "sample"))), lambda s: s["sample"]
        ).alias("samples")
    )
    return counts.join(samples, ["object_id", "risk_type"])


def rule_predictions(buckets: DataFrame, horizon: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Buckets -> open predictions with probability, explanation and recommendation.

    The season is that of the newest data.
    """
    buckets = buckets.withColumn("_month", horizon.select(F.month("data_to")).scalar())
    risk, month = F.col("risk_type"), F.col("_month")
    sizes = (F.col("n_events"), F.col("n_channels"), F.col("n_pickets"))
    return buckets.select(
        "object_id",
        "channel_id",
        "risk_type",
        scores.alarm_probability(risk, *sizes, month).alias("probability"),
        F.lit(cfg.horizon_hours).alias("horizon_hours"),
        text.alarm_explanation(risk, *sizes, F.col("samples"), month).alias("explanation"),
        text.recommendation(risk).alias("recommendation"),
        F.lit("open").alias("status"),
        F.lit("rules").alias("source"),
    )


def score_alarms(
    alarms: DataFrame, channels: DataFrame, cfg: RiskConfig, objects: DataFrame | None = None
) -> DataFrame:
    """The whole rule job; with `objects` (a frame of object_id) only those objects are scored.

    The horizon always comes from the whole mart.
    """
    horizon = data_horizon(alarms, cfg)
    if objects is not None:
        channels = channels.join(objects.select("object_id").distinct(), "object_id", "left_semi")
    buckets = alarm_risk_buckets(recent_classified_alarms(alarms, channels, cfg, horizon))
    return rule_predictions(buckets, horizon, cfg)


def stream_status(alarms: DataFrame, cfg: RiskConfig, slo_seconds: int = 300) -> DataFrame:
    """Alarm count, data range and the latency goal."""
    newest = F.max("event_ts")
    return alarms.agg(
        F.count(F.lit(1)).alias("alarms"),
        (newest - F.make_dt_interval(hours=F.lit(cfg.horizon_hours))).alias("data_from"),
        newest.alias("data_to"),
    ).withColumn("slo_seconds", F.lit(slo_seconds))


def alarm_templates(alarms: DataFrame, channels: DataFrame, cfg: RiskConfig, n: int, risk: str | None = None) -> DataFrame:
    """The newest classified alarm of each known channel, the `n` newest of these."""
    dims = channels.select(F.col("id").alias("channel_id"), "object_id", "sensor_type")
    order = [F.desc("event_ts"), F.desc("event_id")]
    kind = classify_event(F.col("sensor_type"), F.col("value_cat"), cfg)
    classified = alarms.join(dims, "channel_id").withColumn("risk_type", kind).filter(F.col("risk_type").isNotNull())
    if risk is not None:
        classified = classified.filter(F.col("risk_type") == risk)
    return first_per_key(classified, ["channel_id"], order).orderBy(*order).limit(n)
