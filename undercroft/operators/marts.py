"""Warehouse marts built from normalised events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.config import RiskConfig
from undercroft.functions.calendar import hour_number, hour_timestamp
from undercroft.operators.rows import first_per_key

ALARM_COLUMNS = ("event_id", "channel_id", "event_ts", "value_raw", "value_num", "value_cat")


def alarm_mart(events: DataFrame) -> DataFrame:
    """Every alarm once: of the rows that share an event id, in any file, the earliest one."""
    alarms = events.filter(
        F.col("is_alarm") & F.col("event_id").isNotNull() & F.col("event_ts").isNotNull()
    ).select(*ALARM_COLUMNS)
    order = [F.asc(c) for c in ("event_ts", "channel_id", "value_raw")]
    return first_per_key(alarms, ["event_id"], order)


def hourly_mart(events: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Counts and value statistics per channel and hour, for the sensor types with numeric readings.

    Aggregated before the channel table joins: the join sees one row per channel-hour, whatever the journal's size.
    """
    value = F.col("value_num")
    cells = (
        events.filter(F.col("event_ts").isNotNull())
        .groupBy("channel_id", hour_number(F.col("event_ts")).alias("hour_no"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if("is_alarm").alias("n_alarms"),
            F.avg(value).alias("value_mean"),
            F.min(value).alias("value_min"),
            F.max(value).alias("value_max"),
        )
    )
    wanted = channels.filter(F.col("sensor_type").isin(*cfg.hourly_types)).select(F.col("id").alias("channel_id"))
    return cells.join(wanted, "channel_id").select(
        "channel_id", hour_timestamp(F.col("hour_no")).alias("hour_ts"),
        "n_events", "n_alarms", "value_mean", "value_min", "value_max",
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, one row each."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out
