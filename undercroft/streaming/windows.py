"""Event-time aggregates kept by the stream: hourly mart, rolling day counts, guard state of the newest hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.config import RISKS, RiskConfig
from undercroft.functions.calendar import hour_number, hour_timestamp
from undercroft.functions.rules import event_flags
from undercroft.streaming.sources import TIME


def _zoneless(column):
    return column.cast("timestamp_ntz")


def hourly_stream(events: DataFrame, channels: DataFrame, cfg: RiskConfig, lateness: str) -> DataFrame:
    """The hourly mart in append mode: an hour is emitted once the watermark has passed it."""
    wanted = channels.filter(F.col("sensor_type").isin(*cfg.hourly_types)).select(F.col("id").alias("channel_id"))
    return (
        events.withWatermark(TIME, lateness)
        .join(wanted, "channel_id", "left_semi")
        .groupBy(F.window(TIME, "1 hour").alias("w"), "channel_id")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if("is_alarm").alias("n_alarms"),
            F.avg("value_num").alias("value_mean"),
            F.min("value_num").alias("value_min"),
            F.max("value_num").alias("value_max"),
        )
        .select("channel_id", _zoneless(F.col("w.start")).alias("hour_ts"), "n_events", "n_alarms", "value_mean",
                "value_min", "value_max")
    )


def _typed(events: DataFrame, channels: DataFrame) -> DataFrame:
    dims = channels.filter(F.col("object_id").isNotNull()).select(
        F.col("id").alias("channel_id"), "sensor_type", "object_id"
    )
    return events.join(dims, "channel_id")


def rolling_stream(events: DataFrame, channels: DataFrame, cfg: RiskConfig, lateness: str) -> DataFrame:
    """Risk counts of the last 24 hours per object, for every hour.

    Hours are summed first and then slid over, so an event enters one hourly state and not 24 daily ones.
    """
    flags = event_flags(cfg)
    hours = (
        _typed(events.withWatermark(TIME, lateness), channels)
        .groupBy(F.window(TIME, "1 hour").alias("h"), "object_id")
        .agg(F.count(F.lit(1)).alias("n_events"), *[F.count_if(flags[f"ev_{r}"]).alias(f"n_{r}") for r in RISKS])
    )
    day = F.window(F.window_time("h"), f"{cfg.history_hours} hours", "1 hour")
    return (
        hours.groupBy(day.alias("w"), "object_id")
        .agg(F.sum("n_events").alias("ev_24h"), *[F.sum(f"n_{r}").alias(f"{r}_24h") for r in RISKS])
        .select(
            "object_id", _zoneless(F.col("w.end") - F.expr("INTERVAL 1 HOUR")).alias("hour_ts"), "ev_24h",
            *[f"{r}_24h" for r in RISKS],
        )
    )


def guard_stream(events: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Guard state per object in the newest hour that tells one, in update mode: one small state row per object.

    The object counts as guarded if it was at any time of that hour, as in the panel.
    """
    guards = _typed(events, channels).filter(F.col("sensor_type") == cfg.guard_type)
    on = event_flags(cfg)["guard_set"].cast("int")
    hour = hour_number(F.col("event_ts"))
    return guards.groupBy("object_id").agg(F.max(F.struct(hour.alias("hour_no"), on.alias("guard_on"))).alias("s")).select(
        "object_id", hour_timestamp(F.col("s.hour_no")).alias("hour_ts"), "s.guard_on")
