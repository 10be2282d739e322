import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from undercroft.functions import calendar, pickets, values as v
from undercroft.functions.rules import classify_event, event_flags

RAW = ["12,5", "1.0d", " 7 ", "01.01.1970 00:00", "", None, "ok", " ok ", "1 234,5", "-3", "1e3", "12.7"]


@pytest.mark.parametrize("mode, numbers, words", [
    ("strict",
     [12.5, None, 7.0, None, None, None, None, None, None, -3.0, 1000.0, 12.7],
     [None, "1.0d", None, None, "", None, "ok", " ok ", "1 234,5", None, None, None]),
    ("lenient",
     [12.5, None, 7.0, None, None, None, None, None, 1234.5, -3.0, 1000.0, 12.7],
     [None, "1.0d", None, None, None, None, "ok", "ok", None, None, None, None]),
])
def test_numbers_and_words(spark, mode, numbers, words):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(RAW)], "i int, x string")
    df = df.withColumn("n", v.to_number(F.col("x"), mode))
    rows = df.withColumn("w", v.to_category(F.col("x"), F.col("n"), mode)).orderBy("i").collect()
    assert [r["n"] for r in rows] == numbers
    assert [r["w"] for r in rows] == words


def test_value_kind(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(RAW)], "i int, x string")
    kinds = [r[0] for r in df.orderBy("i").select(v.value_kind(F.col("x"))).collect()]
    assert kinds == ["numeric", "categorical", "numeric", "epoch_junk", "empty", "empty", "categorical",
                     "categorical", "numeric", "numeric", "categorical", "numeric"]


def test_alarm_flag_and_ids(spark):
    texts = ["t", "TRUE", "1", "yes", " t ", "f", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(v.alarm_flag(F.col("x"))).collect()] == [True, True, True, False, False, False, None]
    lenient = df.select(v.alarm_flag(F.col("x"), "lenient")).collect()
    assert [r[0] for r in lenient] == [True, True, True, True, True, False, False]
    ids = spark.createDataFrame([("5",), (" 6 ",), ("12.7",), ("bad",), (None,)], "x string")
    assert [r[0] for r in ids.select(v.to_long(F.col("x"))).collect()] == [5, 6, None, None, None]
    with pytest.raises(ValueError):
        v.alarm_flag(F.col("x"), "other")


def test_timestamps(spark):
    rows = [("2024-01-05", "10:20:30"), ("2024-01-05", None), ("2024-01-05", "25:00:00"), ("bad", "10:00:00"),
            ('"2024-01-05"', '"01:02:03"'), ("2024", "10:00:00")]
    df = spark.createDataFrame(rows, "d string, t string")
    strict = [r[0] for r in df.select(v.to_timestamp(F.col("d"), F.col("t"))).collect()]
    lenient = [r[0] for r in df.select(v.to_timestamp(F.col("d"), F.col("t"), "lenient")).collect()]
    full, midnight = dt.datetime(2024, 1, 5, 10, 20, 30), dt.datetime(2024, 1, 5)
    assert strict == [full, None, None, None, None, None]
    assert lenient == [full, midnight, midnight, None, dt.datetime(2024, 1, 5, 1, 2, 3), None]


def test_pickets(spark):
    df = spark.createDataFrame([("ПК 12+5",), ("ПК12",), ("пк 3",), ("x",), (None,)], "n string")
    c = F.col("n")
    rows = df.select(pickets.panel_picket(c), pickets.mart_picket(c), pickets.upload_picket(c)).collect()
    assert [tuple(r) for r in rows] == [
        ("12", "12+5", "12+5"), ("12", "12", "12"), ("", None, "3"), ("", None, None), (None, None, None)]
    order = spark.createDataFrame([("10",), ("9+1",), ("без пикета",)], "n string")
    assert [r[0] for r in order.select(pickets.picket_number(c)).collect()] == [10, 9, None]


def test_hours_and_calendar(spark):
    stamps = [dt.datetime(2024, 1, 7, 13, 59), dt.datetime(1969, 12, 31, 23, 30), dt.datetime(2024, 7, 1)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    number = calendar.hour_number(F.col("ts"))
    back = df.select(number.alias("n"), calendar.hour_timestamp(number).alias("h")).collect()
    assert [r["h"] for r in back] == [s.replace(minute=0) for s in stamps]
    assert back[1]["n"] == -1
    parts = calendar.calendar_features(F.col("ts"))
    row = df.select(*[c.alias(n) for n, c in parts.items()]).collect()
    assert (row[0]["day_of_week"], row[0]["heating_season"], row[0]["flood_season"]) == (0, 1, 0)
    assert (row[2]["day_of_week"], row[2]["heating_season"], row[2]["flood_season"]) == (1, 0, 1)


def test_hours_do_not_depend_on_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30),)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        hour = df.select(calendar.hour_timestamp(calendar.hour_number(F.col("ts")))).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert hour == dt.datetime(2024, 3, 31, 2)


def test_flags_and_class(spark):
    rows = [
        ("Датчик дыма", "Обнаружен дым", False, None), ("Датчик дыма", None, True, None),
        ("Датчик температуры", None, False, 120.0), ("Датчик температуры", None, False, 20.0),
        ("КД Люк", "Не замкнут", False, None), ("КД Люк", "Не замкнут", True, None),
        ("Состояние УИР-Р", "Рычаг сдернут", False, None), ("Тепловой датчик", "Неисправен", True, None),
        (None, "Неисправен", True, None),
    ]
    df = spark.createDataFrame(rows, "sensor_type string, value_cat string, is_alarm boolean, value_num double")
    flags = event_flags(SMALL)
    got = df.select(
        *[flags[f"ev_{r}"] for r in ("fire", "flood", "failure", "intrusion")], flags["temp_val"],
        classify_event(F.col("sensor_type"), F.col("value_cat"), SMALL),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, False, False, False, None, "fire"), (False, False, False, False, None, None),
        (False, False, True, False, None, None), (False, False, False, False, 20.0, None),
        (False, False, False, False, None, "intrusion"), (False, False, False, True, None, "intrusion"),
        (False, False, False, True, None, "intrusion"), (False, False, True, False, None, "failure"),
        (False, False, True, False, None, None),
    ]
