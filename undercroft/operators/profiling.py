"""Data-quality profile of dimensions and journal, and checks of the feature panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.config import RISKS, RiskConfig
from undercroft.functions.values import value_kind


def object_summary(objects: DataFrame) -> DataFrame:
    return objects.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.count_distinct("kind").alias("n_kinds"),
    )


def objects_by_kind(objects: DataFrame) -> DataFrame:
    return objects.groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n")).orderBy("level", F.desc("n"), "kind")


def channel_summary(channels: DataFrame) -> DataFrame:
    return channels.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.count_distinct("object_id").alias("n_objects"),
        F.count_distinct("system_type").alias("n_systems"),
        F.count_distinct("sensor_type").alias("n_types"),
    )


def channels_by(channels: DataFrame, *columns: str) -> DataFrame:
    return channels.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def journal_summary(events: DataFrame, by: str | None = None) -> DataFrame:
    """Rows, date range, channels and alarm share of a journal, or of each file or year when `by` names it."""
    day = F.col("event_ts").cast("date")
    alarms = F.count_if("is_alarm")
    total = F.count(F.lit(1))
    aggregates = [
        total.alias("n_rows"),
        F.min(day).alias("date_min"),
        F.max(day).alias("date_max"),
        F.count_distinct("channel_id").alias("n_channels"),
        alarms.alias("n_alarms"),
        F.when(total > 0, alarms / total).otherwise(F.lit(0.0)).alias("alarm_share"),
    ]
    return events.groupBy(by).agg(*aggregates) if by else events.agg(*aggregates)


def _per_channel(events: DataFrame) -> DataFrame:
    """Journal reduced per channel before any dimension joins."""
    return events.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if("is_alarm").alias("n_alarms")
    )


def _dims(channels: DataFrame) -> DataFrame:
    return channels.withColumnRenamed("id", "channel_id")


def events_by_type(events: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Events and alarms by sensor type; channels missing from the table are kept under a default name."""
    dims = _dims(channels).select("channel_id", "sensor_type", "system_type")
    return (
        _per_channel(events)
        .join(dims, "channel_id", "left")
        .groupBy(
            F.coalesce("sensor_type", F.lit(cfg.no_sensor)).alias("sensor_type"),
            F.coalesce("system_type", F.lit(cfg.no_system)).alias("system_type"),
        )
        .agg(F.sum("n_events").alias("n_events"), F.sum("n_alarms").alias("n_alarms"))
        .orderBy(F.desc("n_events"), "sensor_type", "system_type")
    )


def alarms_by_type(by_type: DataFrame) -> DataFrame:
    return by_type.filter(F.col("n_alarms") > 0).orderBy(F.desc("n_alarms"), "sensor_type", "system_type")


def top_alarm_channels(events: DataFrame, channels: DataFrame, n: int = 15) -> DataFrame:
    """Channels with most alarms, with their metadata; the join sees only `n` rows."""
    top = (
        events.filter("is_alarm")
        .groupBy("channel_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "channel_id")
        .limit(n)
    )
    dims = _dims(channels).select("channel_id", "sensor_type", "system_type", "name", "object_id")
    return top.join(dims, "channel_id", "left")


def orphan_counts(events: DataFrame, channels: DataFrame, objects: DataFrame) -> DataFrame:
    """Distinct journal channels missing from the channel table, and objects of channels missing from the tree."""
    seen = events.select("channel_id").distinct()
    orphans = seen.join(_dims(channels).select("channel_id"), "channel_id", "left_anti")
    used = channels.select("object_id").distinct()
    lost = used.join(objects.select(F.col("id").alias("object_id")), "object_id", "left_anti")
    return orphans.agg(F.count("channel_id").alias("orphan_channels")).withColumn(
        "orphan_objects", lost.agg(F.count("object_id")).scalar()
    )


def value_catalogue(events: DataFrame, top: int) -> DataFrame:
    """The most frequent (raw value, alarm) pairs with the kind of the value."""
    return (
        events.groupBy("value_raw", "is_alarm")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_first("value_raw"), "is_alarm")
        .limit(top)
        .withColumn("kind", value_kind(F.col("value_raw")))
    )


def value_kinds(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("kind").agg(F.sum("n").alias("n"))


def category_values(events: DataFrame, channels: DataFrame, min_count: int = 50) -> DataFrame:
    """Status words per sensor type seen more than `min_count` times."""
    cells = (
        events.filter(F.col("value_cat").isNotNull())
        .groupBy("channel_id", "value_cat", "is_alarm")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        cells.join(_dims(channels).select("channel_id", "sensor_type"), "channel_id")
        .groupBy("sensor_type", "value_cat", "is_alarm")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") > min_count)
    )


def numeric_ranges(events: DataFrame, channels: DataFrame) -> DataFrame:
    """Range and mean of the numbers per sensor type."""
    number = F.col("value_num")
    cells = (
        events.filter(number.isNotNull())
        .groupBy("channel_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min(number).alias("lo"), F.sum(number).alias("total"),
            F.max(number).alias("hi"),
        )
    )
    return (
        cells.join(_dims(channels).select("channel_id", "sensor_type"), "channel_id")
        .groupBy("sensor_type")
        .agg(
            F.sum("n").alias("n"),
            F.min("lo").alias("value_min"),
            (F.sum("total") / F.sum("n")).alias("value_mean"),
            F.max("hi").alias("value_max"),
        )
    )


# ---- checks of the panel ------------------------------------------------------------------------------------------

KEY_COLUMNS = (
    "temp_out", "precip", "humidity", "temp_mean_24h", "gas_max_24h", "temp_trend", "events_per_channel_24h",
)


def _unpivot(wide: DataFrame, names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One wide row with columns `<name>__<value>` -> one row per name."""
    structs = [
        F.struct(F.lit(n).alias("name"), *[F.col(f"{n}__{v}").alias(v) for v in values]) for n in names
    ]
    return wide.select(F.inline(F.array(*structs)))


def fill_rates(panel: DataFrame, columns: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """How many rows carry a value, for all columns in one pass."""
    wide = panel.agg(*[
        x
        for c in columns
        for x in (
            F.count(c).alias(f"{c}__n_filled"),
            F.count(F.lit(1)).alias(f"{c}__n_rows"),
            (F.count(c) / F.count(F.lit(1))).alias(f"{c}__fill_rate"),
        )
    ])
    return _unpivot(wide, columns, ["n_filled", "n_rows", "fill_rate"])


def label_rates(panel: DataFrame) -> DataFrame:
    """Rate, number of positives and largest count per risk."""
    wide = panel.agg(*[
        x
        for r in RISKS
        for x in (
            F.avg(f"y_{r}").alias(f"{r}__rate"),
            F.sum(f"y_{r}").alias(f"{r}__positives"),
            F.max(f"y_{r}_cnt").alias(f"{r}__max_count"),
        )
    ])
    return _unpivot(wide, RISKS, ["rate", "positives", "max_count"]).withColumnRenamed("name", "risk")


def class_means(panel: DataFrame) -> DataFrame:
    """Mean of leading features by class, in one pass; a class without rows gives 0."""
    pairs = [(r, c) for r in RISKS for c in (f"{r}_24h", f"{r}_6h", "al_24h", "ev_24h")]
    wide = panel.agg(*[
        F.coalesce(F.avg(F.when(F.col(f"y_{r}") == k, F.col(c))), F.lit(0.0)).alias(f"{r}__{c}__{k}")
        for r, c in pairs
        for k in (0, 1)
    ])
    rows = [
        F.struct(
            F.lit(r).alias("risk"), F.lit(c).alias("feature"),
            F.col(f"{r}__{c}__0").alias("mean_negative"), F.col(f"{r}__{c}__1").alias("mean_positive"),
        )
        for r, c in pairs
    ]
    return wide.select(F.inline(F.array(*rows)))


def leak_check(panel: DataFrame) -> DataFrame:
    """P(label | event in the current hour) against P(label | none), per risk; NULL when a side has no rows."""
    wide = panel.agg(*[
        x
        for r in RISKS
        for x in (
            F.avg(F.when(F.col(f"{r}_1h") > 0, F.col(f"y_{r}"))).alias(f"{r}__p_event_now"),
            F.avg(F.when(F.col(f"{r}_1h") == 0, F.col(f"y_{r}"))).alias(f"{r}__p_quiet_now"),
        )
    ])
    return _unpivot(wide, RISKS, ["p_event_now", "p_quiet_now"]).withColumnRenamed("name", "risk")


EXAMPLE_COLUMNS = {
    "fire": ("fire_24h", "fire_pickets_6h", "temp_max_24h", "gas_max_24h", "temp_out", "precip"),
    "flood": ("pump_on_24h", "flood_24h", "precip", "temp_out"),
}


def positive_examples(panel: DataFrame, risk: str, n: int = 3) -> DataFrame:
    """Rows with the largest label count of a risk."""
    return (
        panel.filter(F.col(f"y_{risk}") == 1)
        .orderBy(F.desc(f"y_{risk}_cnt"), "object_id", "hour_ts")
        .limit(n)
        .select("object_id", "hour_ts", *EXAMPLE_COLUMNS.get(risk, (f"{risk}_24h",)), f"y_{risk}", f"y_{risk}_cnt")
    )


def build_stats(panel: DataFrame, by: str = "period") -> DataFrame:
    """Rows, objects, positives and rates per period, for the build summary."""
    total = F.count(F.lit(1))
    return panel.groupBy(by).agg(
        total.alias("n_rows"),
        F.count_distinct("object_id").alias("n_objects"),
        *[F.sum(f"y_{r}").alias(f"pos_{r}") for r in RISKS],
        *[F.round(F.sum(f"y_{r}") / total, 5).alias(f"rate_{r}") for r in RISKS],
    )
