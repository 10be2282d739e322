"""Raw text rows -> typed events, objects and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.functions import pickets, values

EVENT_COLUMNS = ("event_id", "channel_id", "event_ts", "is_alarm", "value_raw", "value_num", "value_cat")


def normalize_events(raw: DataFrame, mode: str = "strict") -> DataFrame:
    """Text journal (event_id, channel_id, date, time, alarm, value) -> typed events; rows without ids are dropped."""
    value = F.col("value")
    typed = raw.select(
        values.to_long(F.col("event_id")).alias("event_id"),
        values.to_long(F.col("channel_id")).alias("channel_id"),
        values.to_timestamp(F.col("date"), F.col("time"), mode).alias("event_ts"),
        values.alarm_flag(F.col("alarm"), mode).alias("is_alarm"),
        value.alias("value_raw"),
        values.to_number(value, mode).alias("value_num"),
        *[c for c in ("year",) if c in raw.columns],
    ).filter(F.col("event_id").isNotNull() & F.col("channel_id").isNotNull())
    return typed.withColumn("value_cat", values.to_category(F.col("value_raw"), F.col("value_num"), mode)).select(
        *EVENT_COLUMNS, *[c for c in ("year",) if c in raw.columns]
    )


def uploaded_alarms(raw: DataFrame) -> DataFrame:
    """The upload path: alarms with a usable date, read leniently."""
    return normalize_events(raw, "lenient").filter(F.col("is_alarm") & F.col("event_ts").isNotNull()).drop("is_alarm")


def keep_known(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """`column` becomes NULL where it is not one of `ids` (a one-column frame); no row is dropped."""
    name = ids.columns[0]
    known = ids.select(F.col(name).alias(column)).filter(F.col(column).isNotNull()).distinct()
    known = known.withColumn("_known", F.lit(True))
    order = df.columns
    return (
        df.join(known, column, "left")
        .withColumn(column, F.when(F.col("_known"), F.col(column)))
        .select(*order)
    )


def clean_objects(raw: DataFrame) -> DataFrame:
    """Text objects -> typed objects; a parent that is not among them becomes NULL."""
    typed = raw.select(
        values.to_long(F.col("id").cast("string")).alias("id"),
        values.to_int(F.col("level").cast("string")).alias("level"),
        values.to_long(F.col("parent_id").cast("string")).alias("parent_id"),
        "kind",
        "name",
        *[c for c in ("_position",) if c in raw.columns],
    )
    return keep_known(typed, "parent_id", typed.select("id"))


def clean_channels(raw: DataFrame, objects: DataFrame | None = None, mode: str = "strict") -> DataFrame:
    """Text channels -> typed channels with their picket.

    lenient (upload): blanks instead of missing texts, any letter case of the picket mark, and an object that is
    not in `objects` becomes NULL.
    """
    lenient = mode == "lenient"

    def text(name: str):
        return F.coalesce(F.col(name), F.lit("")).alias(name) if lenient else F.col(name)

    picket = pickets.upload_picket if lenient else pickets.mart_picket
    typed = raw.select(
        values.to_long(F.col("id").cast("string")).alias("id"),
        text("system_type"),
        text("sensor_type"),
        "tag",
        text("name"),
        values.to_long(F.col("object_id").cast("string")).alias("object_id"),
        picket(F.col("name")).alias("picket"),
        *[c for c in ("_position",) if c in raw.columns],
    )
    return typed if objects is None else keep_known(typed, "object_id", objects.select("id"))
