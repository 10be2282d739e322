"""Stream results that leave nothing out: every batch adds mergeable tallies, and readers merge them.

Tallies of a channel and hour are counts, sums and extremes, so the parts that several batches hold of one hour add up,
in any order and however late they come: there is no watermark and no state to outgrow. Batches go to a `LevelLog` by
day, which merges old ones as it grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undercroft.config import RISKS, RiskConfig
from undercroft.functions.calendar import hour_timestamp
from undercroft.operators import hourly
from undercroft.operators.tallies import PERIOD, channel_hour_tallies, typed_channel_hours
from undercroft.plans.panel import panel_channels
from undercroft.streaming.level_log import LevelLog

_KEYS = (PERIOD, "channel_id", "hour_no")


def _merge_of(name: str) -> Column:
    if name.endswith("_max") or name == "guard_set":
        return F.max(name).alias(name)
    return (F.min(name) if name.endswith("_min") else F.sum(name)).alias(name)


def batch_tallies(events: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Tallies of one batch, with the least number seen beside those that the panel needs; the batch is read once."""
    return channel_hour_tallies(events, cfg, F.min("value_num").alias("num_min"))


def _merge(rows: DataFrame) -> DataFrame:
    values = [c for c in rows.columns if c not in (*_KEYS, "day")]
    merged = rows.groupBy(*_KEYS).agg(*[_merge_of(c) for c in values])
    return merged.withColumn("day", hour_timestamp(F.col("hour_no")).cast("date")).select(*rows.columns)


def tally_log(spark: SparkSession, path: str) -> LevelLog:
    return LevelLog(spark, path, _merge, ["day"])


def add_tallies(events: DataFrame, cfg: RiskConfig, path: str, source: str, batch_id: int) -> bool:
    """Adds one batch of events to the log at `path`; a batch that the log holds already is left out."""
    log = tally_log(events.sparkSession, path)
    if log.holds(source, batch_id):
        return False
    rows = batch_tallies(events, cfg).withColumn("day", hour_timestamp(F.col("hour_no")).cast("date"))
    return log.add(rows, source, batch_id)


def run_tallies(events: DataFrame, cfg: RiskConfig, path: str, checkpoint: str) -> None:
    """Adds the tallies of all events that have arrived to the log at `path`. The checkpoint tells streams apart."""
    query = (events.writeStream.foreachBatch(lambda batch, batch_id: add_tallies(batch, cfg, path, checkpoint, batch_id))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def merged_tallies(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The log with one row per channel and hour; `since` prunes it to the days from then on."""
    condition = None if since is None else F.col("day") >= F.lit(since).cast("date")
    return tally_log(spark, path).merged(condition).drop("day")


def hourly_mart(tallies: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """The hourly mart of merged tallies."""
    wanted = channels.filter(F.col("sensor_type").isin(*cfg.hourly_types)).select(F.col("id").alias("channel_id"))
    return tallies.join(wanted, "channel_id").select(
        "channel_id", hour_timestamp(F.col("hour_no")).alias("hour_ts"), "n_events", "n_alarms",
        (F.col("num_sum") / F.nullif(F.col("num_n"), F.lit(0))).alias("value_mean"),
        F.col("num_min").alias("value_min"), F.col("num_max").alias("value_max"))


def typed(tallies: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    return typed_channel_hours(tallies.drop("num_min"), panel_channels(channels), cfg)


def new_failures(tallies: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(channel_id, object_id, hour_ts) of channels that fail now and did not during the day before."""
    # One period: a stream does not part years as the journal's files do.
    hours = typed(tallies, channels, cfg).withColumn(PERIOD, F.lit(0))
    found = hourly.new_failures(hourly.mark_channel_hours(hours, cfg))
    return found.select("channel_id", "object_id", hour_timestamp(F.col("hour_no")).alias("hour_ts"))


def rolling_counts(tallies: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Risk counts of the last 24 hours per object, for every hour that has an event in them, up to the newest one's.

    An hour enters the sums of the hours after it until the object's next hour of the same day; the rows between two
    hours with events are made from the first of them, so the sums come from a range over sparse hours.
    """
    hours = typed(tallies, channels, cfg).groupBy("object_id", "hour_no").agg(
        F.sum("n_events").alias("n"), *[F.sum(f"n_{r}").alias(r) for r in RISKS])
    span = cfg.history_hours
    series = Window.partitionBy("object_id").orderBy("hour_no")
    following = F.least(F.coalesce(F.lead("hour_no").over(series), F.col("hour_no") + span), F.col("hour_no") + span)
    grid = hours.withColumn("following", following).withColumn(
        "at", F.explode(F.sequence(F.col("hour_no"), F.col("following") - 1)))
    own = F.col("at") == F.col("hour_no")
    dense = grid.select("object_id", "at", *[F.when(own, F.col(c)).otherwise(0).alias(c) for c in ("n", *RISKS)])
    day = Window.partitionBy("object_id").orderBy("at").rangeBetween(-(span - 1), 0)
    return dense.select(
        "object_id", hour_timestamp(F.col("at")).alias("hour_ts"), F.sum("n").over(day).alias("ev_24h"),
        *[F.sum(r).over(day).alias(f"{r}_24h") for r in RISKS])


def guard_state(tallies: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Guard state of each object in the newest hour that tells one: on if it was on at any time of that hour."""
    hours = typed(tallies, channels, cfg).filter(F.col("guard_state").isNotNull())
    newest = hours.groupBy("object_id").agg(F.max(F.struct("hour_no", "guard_state")).alias("s"))
    return newest.select("object_id", hour_timestamp(F.col("s.hour_no")).alias("hour_ts"), F.col("s.guard_state").alias("guard_on"))
