"""Channel-hours -> object-hours: noisy channels, new failures and the hourly measures of an object."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.config import RiskConfig
from undercroft.functions.calendar import hour_number
from undercroft.operators.tallies import PERIOD, with_period


def mark_channel_hours(channel_hours: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Adds, per channel and period, whether it is noisy and how many failures its last day held.

    The series is sparse, so the look-back is a range of hours, never a number of rows. Both windows share one
    exchange and one sort by (period, channel, hour); a group holds at most one row per hour.
    """
    series = Window.partitionBy(PERIOD, "channel_id").orderBy("hour_no")
    channel = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last_day = series.rangeBetween(-cfg.history_hours, -1)
    return channel_hours.select(
        "*",
        (F.sum("n_fire").over(channel) > cfg.noisy_fire_events).alias("noisy_fire"),
        (F.sum("n_flood").over(channel) > cfg.noisy_flood_events).alias("noisy_flood"),
        F.coalesce(F.sum("n_failure").over(last_day), F.lit(0)).alias("prev_failure"),
    )


def noisy_channels(channel_hours: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Channels with more fire (or flood) events in a period than a working sensor can have."""
    return channel_hours.groupBy(PERIOD, "channel_id").agg(
        (F.sum("n_fire") > cfg.noisy_fire_events).alias("noisy_fire"),
        (F.sum("n_flood") > cfg.noisy_flood_events).alias("noisy_flood"),
    )


def new_failures(marked: DataFrame) -> DataFrame:
    """Channel-hours that fail now and did not fail during the day before."""
    return marked.filter((F.col("n_failure") > 0) & (F.col("prev_failure") == 0))


def object_hours(marked: DataFrame, cfg: RiskConfig) -> DataFrame:
    """One sparse row per (period, object, hour).

    The input has one row per channel and hour, so distinct channels are plain counts and the chattiest channel is
    a plain maximum; only pickets need a distinct count. Averages stay as sum and count.
    """
    fire_picket = F.when(F.col("n_fire") > 0, F.col("picket"))
    if not cfg.count_blank_picket:
        fire_picket = F.nullif(fire_picket, F.lit(""))
    return marked.groupBy(PERIOD, "object_id", "hour_no").agg(
        F.sum("n_events").alias("n_events"),
        F.count(F.lit(1)).alias("n_channels_active"),
        F.sum("n_alarms").alias("n_alarms"),
        F.sum("n_fire").alias("n_fire"),
        F.sum("n_flood").alias("n_flood"),
        F.sum("n_failure").alias("n_failure"),
        F.sum("n_intrusion").alias("n_intrusion"),
        F.sum(F.when(~F.col("noisy_fire"), F.col("n_fire")).otherwise(0)).alias("n_fire_clean"),
        F.sum(F.when(~F.col("noisy_flood"), F.col("n_flood")).otherwise(0)).alias("n_flood_clean"),
        F.count_distinct(fire_picket).alias("n_fire_pickets"),
        F.count_if(F.col("n_intrusion") > 0).alias("n_intrusion_channels"),
        F.sum("n_pump_on").alias("n_pump_on"),
        F.sum("n_fan_on").alias("n_fan_on"),
        (F.sum("temp_sum") / F.nullif(F.sum("temp_n"), F.lit(0))).alias("temp_mean"),
        F.max("temp_max").alias("temp_max"),
        F.min("temp_min").alias("temp_min"),
        (F.sum("gas_sum") / F.nullif(F.sum("gas_n"), F.lit(0))).alias("gas_mean"),
        F.max("gas_max").alias("gas_max"),
        F.max("guard_state").alias("guard_state"),
        F.max("n_events").alias("max_events_per_channel"),
        F.count_if((F.col("n_failure") > 0) & (F.col("prev_failure") == 0)).alias("n_failure_new"),
    )


def period_bounds(events: DataFrame, channels: DataFrame) -> DataFrame:
    """First and last hour of each period over the events the panel uses: one row per period.

    A narrow scan of two columns, combined per channel before the channel table joins.
    """
    ends = (
        with_period(events)
        .filter(F.col("event_ts").isNotNull())
        .groupBy(PERIOD, "channel_id")
        .agg(F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))
    )
    used = channels.filter(F.col("object_id").isNotNull()).select(F.col("id").alias("channel_id"))
    return (
        ends.join(used, "channel_id")
        .groupBy(PERIOD)
        .agg(
            hour_number(F.min("first_ts")).alias("hour_first"),
            hour_number(F.max("last_ts")).alias("hour_last"),
        )
    )


def object_profile(channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Which sensor families an object has: seven conditional counts, the total and its distinct pickets."""
    kind = F.col("sensor_type")
    return (
        channels.filter(F.col("object_id").isNotNull())
        .groupBy("object_id")
        .agg(
            F.count(F.lit(1)).alias("n_channels"),
            F.count_if(kind == cfg.smoke_type).alias("n_smoke"),
            F.count_if(kind == cfg.heat_type).alias("n_heat"),
            F.count_if(kind == cfg.pump_type).alias("n_pump"),
            F.count_if(kind == cfg.flood_sensor_type).alias("n_flood_sensor"),
            F.count_if(kind.isin(*cfg.temp_types)).alias("n_temp"),
            F.count_if(kind.isin(*cfg.gas_types)).alias("n_gas"),
            F.count_if(kind.isin(*cfg.door_types)).alias("n_guard"),
            F.count_distinct(F.nullif(F.col("picket"), F.lit(""))).alias("n_pickets"),
        )
    )


def live_objects(object_hours_: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Objects that really sent data in a period."""
    return (
        object_hours_.groupBy(PERIOD, "object_id")
        .agg(F.sum("n_events").alias("n_events"))
        .filter(F.col("n_events") >= cfg.min_object_events)
    )
