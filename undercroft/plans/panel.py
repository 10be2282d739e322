"""The feature panel: a dense object-by-hour series with past windows and future labels.

Shuffles, from the raw journal down:
  1. tallies per (period, channel, hour), after map-side combine - the only one that grows with the journal;
  2. channel-hours by (period, channel): type lookup, noisy channels and new failures share it;
  3. object-hours (two small steps because of the distinct pickets);
  4. sparse object-hours by (object, period): liveness, gap filling and all rolling windows share it.
The dense grid is produced inside the tasks of step 4 and never crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from undercroft.config import PANEL_COLUMNS, RISKS, RiskConfig
from undercroft.functions.calendar import calendar_features, hour_timestamp
from undercroft.functions.pickets import panel_picket
from undercroft.operators import hourly
from undercroft.operators.tallies import PERIOD, channel_hour_tallies, typed_channel_hours
from undercroft.session import stage

COUNTS = (
    "n_events", "n_channels_active", "n_alarms", "n_fire", "n_flood", "n_failure", "n_failure_new", "n_intrusion",
    "n_fire_clean", "n_flood_clean", "n_fire_pickets", "n_intrusion_channels", "n_pump_on", "n_fan_on",
    "max_events_per_channel",
)
MEASURES = ("temp_mean", "temp_max", "temp_min", "gas_mean", "gas_max", "guard_state")
PROFILE = ("n_channels", "n_smoke", "n_heat", "n_pump", "n_flood_sensor", "n_temp", "n_gas", "n_guard", "n_pickets")


def panel_channels(channels: DataFrame) -> DataFrame:
    """Channels with the panel's own picket label, read from the channel name."""
    return channels.select("id", "sensor_type", "object_id", panel_picket(F.col("name")).alias("picket"))


def typed_hours(events: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Journal -> channel-hours of channels with an object, read through their sensor types."""
    return typed_channel_hours(channel_hour_tallies(events, cfg), panel_channels(channels), cfg)


def sparse_object_hours(events: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Journal -> object-hours that hold at least one event."""
    return hourly.object_hours(hourly.mark_channel_hours(typed_hours(events, channels, cfg), cfg), cfg)


def hour_bounds(typed: DataFrame) -> DataFrame:
    """First and last hour of each period, from channel-hours: one row per period."""
    return typed.groupBy(PERIOD).agg(F.min("hour_no").alias("hour_first"), F.max("hour_no").alias("hour_last"))


#: Rows of the dense grid that one task makes, about.
GRID_ROWS = 2_000_000


def grid_tasks(typed: DataFrame) -> int:
    """Tasks that the dense grid needs: by its rows, known before it is made, but no fewer than a shuffle has."""
    ends = typed.groupBy(PERIOD).agg(
        F.count_distinct("object_id").alias("objects"), (F.max("hour_no") - F.min("hour_no") + 1).alias("hours"))
    rows = ends.agg(F.coalesce(F.sum(F.col("objects") * F.col("hours")), F.lit(0)).alias("n")).first()["n"]
    return max(int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // GRID_ROWS))


def dense_object_hours(
    sparse: DataFrame, bounds: DataFrame, cfg: RiskConfig, tasks: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Fills every missing hour of each live object between the period's first and last hour.

    Each sparse row expands to itself plus the empty hours up to the next row, so the grid needs no cross join and
    no join back. Counts are 0 in the filled hours, measures NULL. `bounds` has one row per period, hence broadcast.
    """
    ordered = Window.partitionBy("object_id", PERIOD).orderBy("hour_no")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A fixed number of partitions: rows multiply below, so sizes measured here must not merge partitions.
    marked = (
        sparse.repartition(tasks, "object_id", PERIOD)
        .select(
            "*",
            F.sum("n_events").over(whole).alias("_total"),
            F.lead("hour_no").over(ordered).alias("_next"),
            F.row_number().over(ordered).alias("_rank"),
        )
        .filter(F.col("_total") >= cfg.min_object_events)
        .join(F.broadcast(bounds), PERIOD)
    )
    start = F.when(F.col("_rank") == 1, F.col("hour_first")).otherwise(F.col("hour_no"))
    stop = F.coalesce(F.col("_next") - 1, F.col("hour_last"))
    filled = marked.withColumn("_hour", F.explode(F.sequence(start, stop)))
    own = F.col("_hour") == F.col("hour_no")
    return filled.select(
        PERIOD,
        "object_id",
        F.col("_hour").alias("hour_no"),
        "hour_last",
        *[F.when(own, F.col(c)).otherwise(F.lit(0)).alias(c) for c in COUNTS],
        *[F.when(own, F.col(c)).alias(c) for c in MEASURES],
        *carry,
    )


# Counts that are summed over windows; each gets one running total.
SUMMED = (
    "n_events", "n_alarms", "n_fire", "n_flood", "n_failure", "n_failure_new", "n_intrusion", "n_pump_on", "n_fan_on",
    "n_channels_active", "n_fire_clean", "n_flood_clean",
)


def _series() -> WindowSpec:
    return Window.partitionBy("object_id", PERIOD).orderBy("hour_no")


def with_running_totals(dense: DataFrame) -> DataFrame:
    """Adds the running total of each summed count, so that a window sum is a difference of two totals.

    A sliding frame would visit up to 24 rows per row and count; whole numbers make the difference exact.
    """
    past = _series().rowsBetween(Window.unboundedPreceding, 0)
    return dense.select("*", *[F.sum(c).over(past).alias(f"_t_{c}") for c in SUMMED])


def _past_sum(count: str, hours: int, series: WindowSpec) -> Column:
    total = F.col(f"_t_{count}")
    return total - F.coalesce(F.lag(total, hours).over(series), F.lit(0))


def _next_sum(count: str, hours: int, series: WindowSpec) -> Column:
    """Sum over the following hours, the present one excluded; NULL where the series ends before."""
    total = F.col(f"_t_{count}")
    return F.lead(total, hours).over(series) - total


def rolled_features(cfg: RiskConfig) -> dict[str, Column]:
    """Past windows of 6 and 24 hours; averages are means of hourly means, maxima are maxima of hourly values.

    Frames count rows: on a dense series a row is an hour, so they equal ranges of hours.
    """
    short, day = cfg.short_hours, cfg.history_hours
    series = _series()
    w6 = series.rowsBetween(-(short - 1), 0)
    w24 = series.rowsBetween(-(day - 1), 0)
    past = series.rowsBetween(Window.unboundedPreceding, 0)
    out: dict[str, Column] = {}
    for name, count in (
        ("ev", "n_events"), ("al", "n_alarms"), ("fire", "n_fire"), ("flood", "n_flood"),
        ("failure", "n_failure"), ("intrusion", "n_intrusion"),
    ):
        out[f"{name}_1h"] = F.col(count)
        out[f"{name}_6h"] = _past_sum(count, short, series)
        out[f"{name}_24h"] = _past_sum(count, day, series)
    out["failure_new_24h"] = _past_sum("n_failure_new", day, series)
    out["fire_pickets_6h"] = F.max("n_fire_pickets").over(w6)
    out["intrusion_channels_6h"] = F.max("n_intrusion_channels").over(w6)
    out["pump_on_6h"] = _past_sum("n_pump_on", short, series)
    out["pump_on_24h"] = _past_sum("n_pump_on", day, series)
    out["fan_on_24h"] = _past_sum("n_fan_on", day, series)
    out["chatter_max_24h"] = F.max("max_events_per_channel").over(w24)
    out["channel_touches_24h"] = _past_sum("n_channels_active", day, series)
    out["temp_mean_6h"] = F.avg("temp_mean").over(w6)
    out["temp_mean_24h"] = F.avg("temp_mean").over(w24)
    out["temp_max_6h"] = F.max("temp_max").over(w6)
    out["temp_max_24h"] = F.max("temp_max").over(w24)
    out["temp_min_24h"] = F.min("temp_min").over(w24)
    out["gas_mean_24h"] = F.avg("gas_mean").over(w24)
    out["gas_max_6h"] = F.max("gas_max").over(w6)
    out["gas_max_24h"] = F.max("gas_max").over(w24)
    out["guard_on"] = F.coalesce(F.last("guard_state", ignorenulls=True).over(past), F.lit(0))
    return out


def future_labels(cfg: RiskConfig) -> dict[str, Column]:
    """Counts over the next day, from the next hour on: clean fire and flood, new failures, all intrusions.

    Rows whose label window leaves the period are dropped, so the look-ahead always finds its row.
    """
    source = {"fire": "n_fire_clean", "flood": "n_flood_clean", "failure": "n_failure_new", "intrusion": "n_intrusion"}
    series = _series()
    return {f"y_{r}_cnt": _next_sum(source[r], cfg.horizon_hours, series) for r in RISKS}


def within_horizon(cfg: RiskConfig) -> Column:
    """Rows whose label window ends inside the period."""
    return F.col("hour_no") <= F.col("hour_last") - cfg.horizon_hours


def daily_weather(weather: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Weather under the panel's names, one row per calendar day (which bounds its size)."""
    day = F.date_add("day", cfg.weather_lag_days) if cfg.weather_lag_days else F.col("day")
    return weather.groupBy(day.alias("day")).agg(
        F.first("temp_mean").alias("temp_out"),
        F.first("precipitation_mm").alias("precip"),
        F.first("humidity").alias("humidity"),
    )


def assemble(dense: DataFrame, weather: DataFrame | None, cfg: RiskConfig) -> DataFrame:
    """Dense object-hours -> the 67 panel columns (plus the period)."""
    rolled = with_running_totals(dense).select(
        PERIOD,
        "object_id",
        "hour_no",
        "hour_last",
        *PROFILE,
        *[c.alias(n) for n, c in rolled_features(cfg).items()],
        *[c.alias(n) for n, c in future_labels(cfg).items()],
    ).filter(within_horizon(cfg))
    hour_ts = hour_timestamp(F.col("hour_no"))
    rolled = rolled.withColumn("hour_ts", hour_ts)
    rolled = rolled.withColumns(calendar_features(F.col("hour_ts")))
    if weather is None:
        rolled = rolled.withColumns({c: F.lit(None).cast("double") for c in ("temp_out", "precip", "humidity")})
    else:
        rolled = rolled.join(F.broadcast(daily_weather(weather, cfg)), "day", "left")
    touches = F.col("channel_touches_24h")
    rolled = rolled.withColumns({
        "events_per_channel_24h": F.when(touches > 0, F.col("ev_24h").cast("double") / touches),
        "temp_trend": F.col("temp_mean_6h") - F.col("temp_mean_24h"),
        **{f"y_{r}": (F.col(f"y_{r}_cnt") > 0).cast("int") for r in RISKS},
    })
    return rolled.select(PERIOD, *PANEL_COLUMNS)


def build_panel(
    events: DataFrame, channels: DataFrame, weather: DataFrame | None, cfg: RiskConfig
) -> DataFrame:
    """The full feature panel of every period in `events`.

    The journal is scanned once: its channel-hours, a small part of it, are written and give both the rows and the
    bounds of the grid.
    """
    return panel_of_hours(stage(typed_hours(events, channels, cfg), "channel-hours"), channels, weather, cfg)


def panel_of_hours(typed: DataFrame, channels: DataFrame, weather: DataFrame | None, cfg: RiskConfig) -> DataFrame:
    """The panel from channel-hours."""
    sparse = hourly.object_hours(hourly.mark_channel_hours(typed, cfg), cfg)
    profile = hourly.object_profile(panel_channels(channels), cfg)
    dense = dense_object_hours(sparse.join(profile, "object_id"), hour_bounds(typed), cfg, grid_tasks(typed), carry=PROFILE)
    return assemble(dense, weather, cfg)


def dense_grid(events: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Live objects x hours with the hourly measures, before any rolling window."""
    typed = stage(typed_hours(events, channels, cfg), "channel-hours")
    sparse = hourly.object_hours(hourly.mark_channel_hours(typed, cfg), cfg)
    dense = dense_object_hours(sparse, hour_bounds(typed), cfg, grid_tasks(typed))
    return dense.withColumn("hour_ts", hour_timestamp(F.col("hour_no")))
