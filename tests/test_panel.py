import dataclasses
import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import H0, SMALL, at, channels_frame, events_frame
from undercroft.config import PANEL_COLUMNS, RISKS
from undercroft.functions.rules import event_flags
from undercroft.operators.tallies import channel_hour_tallies, typed_channel_hours
from undercroft.plans import panel
from workload.binding import CONFIG, Tables

SMOKE, TEMP, GUARD = "Датчик дыма", "Датчик температуры", "Состояние охраны"
FIRE = "Обнаружен дым"


def build(spark, channels, events, cfg=SMALL, weather=None):
    return panel.build_panel(events_frame(spark, events), channels_frame(spark, channels), weather, cfg)


def by_hour(df, column, object_id=1):
    rows = df.filter(F.col("object_id") == object_id).orderBy("hour_ts").collect()
    return {int((r["hour_ts"] - H0).total_seconds() // 3600): r[column] for r in rows}


def test_labels_start_next_hour_and_stop_after_24(spark):
    """Events at h = 0, 1 and 25; a quiet event at 60 keeps the horizon open."""
    rows = [(1, at(0.2), True, None, FIRE), (1, at(1.2), True, None, FIRE), (1, at(25.2), True, None, FIRE),
            (1, at(60), False, 1.0, None)]
    df = build(spark, [(1, SMOKE, "ПК 1", 1)], rows).cache()
    label = by_hour(df, "y_fire_cnt")
    assert [label[h] for h in (0, 1, 2, 24, 25)] == [1, 1, 1, 1, 0]
    past = by_hour(df, "fire_24h")
    assert [past[h] for h in (0, 1, 23, 24, 25)] == [1, 2, 2, 1, 1]
    assert max(label) == 60 - 24 and df.columns == ["period", *PANEL_COLUMNS]


def test_new_failures_look_back_by_hours_not_rows(spark):
    bad = "Неисправен"
    rows = [(1, at(h), True, None, bad) for h in (0, 10, 40)] + [(2, at(70), False, 1.0, None)]
    df = build(spark, [(1, SMOKE, "ПК 1", 1), (2, SMOKE, "ПК 2", 1)], rows)
    new = by_hour(df, "failure_new_24h")
    assert (new[0], new[10], new[39], new[40]) == (1, 1, 0, 1)


def test_guard_state_carries_over_gaps(spark):
    rows = [(1, at(0), False, None, "На охране"), (1, at(30), False, None, "Снято с охраны"), (1, at(80), False, 1.0, None)]
    state = by_hour(build(spark, [(1, GUARD, "x", 1)], rows), "guard_on")
    assert [state[h] for h in (0, 29, 30, 50)] == [1, 1, 0, 0]


def test_noisy_channels_leave_labels_but_not_features(spark):
    noisy = [(1, at(10 + i / 100), True, None, FIRE) for i in range(5)]
    rows = [(2, at(0), False, 1.0, None), *noisy, (2, at(12), True, None, FIRE), (2, at(60), False, 1.0, None)]
    df = build(spark, [(1, SMOKE, "ПК 1", 1), (2, SMOKE, "ПК 2", 1)], rows).cache()
    assert by_hour(df, "y_fire_cnt")[0] == 1
    assert by_hour(df, "fire_24h")[12] == 6
    assert by_hour(df, "chatter_max_24h")[12] == 5


@pytest.mark.parametrize("count_blank, expected", [(True, 2), (False, 1)])
def test_blank_picket(spark, count_blank, expected):
    rows = [(1, at(0), True, None, FIRE), (2, at(0), True, None, FIRE), (1, at(40), False, 1.0, None)]
    cfg = dataclasses.replace(SMALL, count_blank_picket=count_blank)
    df = build(spark, [(1, SMOKE, "ПК 7+3", 1), (2, SMOKE, "no picket", 1)], rows, cfg)
    assert by_hour(df, "fire_pickets_6h")[0] == expected


def test_windows_do_not_cross_years(spark):
    eve = dt.datetime(2024, 12, 31, 23)
    rows = [(1, eve - dt.timedelta(hours=40), False, 1.0, None), (1, eve, True, None, FIRE),
            (1, eve + dt.timedelta(hours=1), False, 1.0, None), (1, eve + dt.timedelta(hours=60), False, 1.0, None)]
    out = build(spark, [(1, SMOKE, "ПК 1", 1)], rows).orderBy("hour_ts").collect()
    new_year = [r for r in out if r["period"] == 2025]
    assert new_year[0]["hour_ts"] == dt.datetime(2025, 1, 1) and new_year[0]["fire_24h"] == 0
    assert max(r["hour_ts"] for r in out if r["period"] == 2024) == eve - dt.timedelta(hours=24)
    assert all(r["y_fire_cnt"] == 0 for r in out if r["hour_ts"] < eve - dt.timedelta(hours=24))


def test_weather_optional_and_lagged(spark):
    rows = [(1, at(0), False, 1.0, None), (1, at(72), False, 1.0, None)]
    weather = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 1.0, 2.0, 3.0), (dt.date(2024, 1, 2), 4.0, None, 6.0)],
        "day date, temp_mean double, precipitation_mm double, humidity double")
    channels = [(1, SMOKE, "x", 1)]
    same = by_hour(build(spark, channels, rows, SMALL, weather), "temp_out")
    assert (same[0], same[24], same[48]) == (1.0, 4.0, None)
    lagged = by_hour(build(spark, channels, rows, dataclasses.replace(SMALL, weather_lag_days=1), weather), "temp_out")
    assert (lagged[0], lagged[24], lagged[48]) == (None, 1.0, 4.0)
    assert set(by_hour(build(spark, channels, rows), "precip").values()) == {None}


def test_empty_journal_gives_empty_panel(spark):
    df = build(spark, [(1, SMOKE, "x", 1)], [])
    assert df.count() == 0 and len(df.columns) == 68


def test_mean_of_hourly_means_and_impossible_temperature(spark):
    rows = [(1, at(0), False, 10.0, None), (1, at(0.5), False, 20.0, None), (1, at(1), False, 30.0, None),
            (1, at(2), False, 500.0, None), (1, at(40), False, 1.0, None)]
    df = build(spark, [(1, TEMP, "x", 1)], rows).cache()
    assert by_hour(df, "temp_mean_6h")[1] == pytest.approx((15 + 30) / 2)
    assert by_hour(df, "failure_1h")[2] == 1 and by_hour(df, "temp_max_6h")[2] == 30.0


@pytest.fixture(scope="module")
def bound(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    return t, panel.build_panel(t.events, t.channels, t.weather, CONFIG).toPandas()


def test_grid_is_dense_and_unique(bound):
    _, df = bound
    assert not df.duplicated(["object_id", "hour_ts"]).any()
    hours = df.groupby("object_id")["hour_ts"].agg(["min", "max", "count"])
    assert hours["count"].nunique() == 1
    span = (hours["max"].iloc[0] - hours["min"].iloc[0]) / pd.Timedelta(hours=1) + 1
    assert span == hours["count"].iloc[0]


def test_rolling_equals_plain_pandas(bound):
    _, df = bound
    for _, part in df.sort_values("hour_ts").groupby("object_id"):
        for name in ("ev", "al", *RISKS):
            one = part[f"{name}_1h"]
            assert (one.rolling(6, min_periods=1).sum() == part[f"{name}_6h"]).all()
            assert (one.rolling(24, min_periods=1).sum() == part[f"{name}_24h"]).all()
        ahead = part["intrusion_1h"][::-1].rolling(24, min_periods=1).sum()[::-1].shift(-1)
        inside = ahead.iloc[:-24]
        assert (inside == part["y_intrusion_cnt"].iloc[:-24]).all()


def test_tallies_equal_row_flags(spark, bound):
    """The tallies read through the sensor type equal flags computed row by row."""
    t, _ = bound
    typed = typed_channel_hours(channel_hour_tallies(t.events, CONFIG), panel.panel_channels(t.channels), CONFIG)
    dims = t.channels.filter("object_id is not null").select(F.col("id").alias("channel_id"), "sensor_type")
    flags = event_flags(CONFIG)
    plain = t.events.join(dims, "channel_id").groupBy("channel_id").agg(
        *[F.count_if(flags[f"ev_{r}"]).alias(f"n_{r}") for r in RISKS],
        F.count_if(flags["pump_on"]).alias("n_pump_on"), F.count_if(flags["fan_on"]).alias("n_fan_on"),
        F.count(flags["temp_val"]).alias("temp_n"),
    )
    names = [c for c in plain.columns if c != "channel_id"]
    summed = typed.groupBy("channel_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, plain.select("channel_id", *names).collect()))


def test_every_event_is_counted_once(bound):
    t, df = bound
    last = df["hour_ts"].max()
    kept = set(df["object_id"])
    dims = t.channels.filter("object_id is not null").select(F.col("id").alias("channel_id"), "object_id")
    events = t.events.join(dims, "channel_id").select("object_id", "event_ts").toPandas()
    inside = events[(events["event_ts"] < last + pd.Timedelta(hours=1)) & events["object_id"].isin(kept)]
    assert df["ev_1h"].sum() == len(inside)
