import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, at, channels_frame, events_frame
from undercroft import schemas
from undercroft.operators import marts
from undercroft.operators.alarm_risk import score_alarms
from undercroft.plans import alarm_store
from undercroft.streaming import failures, ingest, run, windows
from undercroft.streaming.sources import file_stream, wire_alarms, wire_stream, with_event_time

SMOKE = "Датчик дыма"
FIRE = "Обнаружен дым"


def write_parts(frame, folder, parts):
    """Writes groups of rows as files in order, so that each becomes one micro-batch."""
    for i, condition in enumerate(parts):
        frame.filter(condition).coalesce(1).write.parquet(f"{folder}/part{i}")


def stream_of(spark, folder, schema):
    return with_event_time(file_stream(spark, f"{folder}/part*", schema, max_files=1))


@pytest.fixture
def three_days(spark, tmp_path):
    """A journal in three files, one day each, with an event of the first day arriving in the second file."""
    rows = [(c, at(h + c / 10), h % 3 == 0, float(h), "Неисправен" if h in (5, 15, 45, 46, 71) and c == 1 else FIRE if h % 11 == 0 else None)
            for h in range(72) for c in (1, 2)]
    events = events_frame(spark, rows).withColumn("late", F.col("event_ts") == F.lit(at(23.1)).cast("timestamp_ntz"))
    folder = str(tmp_path / "in")
    first, second = F.lit(at(24)), F.lit(at(48))
    late = F.col("event_id") == 46
    write_parts(events.drop("late"), folder, [
        (F.col("event_ts") < first) & ~late, (F.col("event_ts").between(first, F.lit(at(47.9)))) | late, F.col("event_ts") >= second])
    return folder, events.drop("late")


@pytest.fixture
def channels(spark):
    return channels_frame(spark, [(1, "Датчик температуры", "ПК 1", 1), (2, SMOKE, "ПК 2", 1)])


def test_hourly_stream_equals_batch(spark, tmp_path, three_days, channels):
    folder, events = three_days
    stream = windows.hourly_stream(stream_of(spark, folder, schemas.EVENTS), channels, SMALL, "3 hours")
    got = run.append_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = dt.datetime(2024, 1, 3, 23) + dt.timedelta(minutes=12) - dt.timedelta(hours=4)
    want = marts.hourly_mart(events, channels, SMALL).filter(F.col("hour_ts") <= F.lit(closed))
    assert got.count() == want.count() > 60
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_failure_stream_remembers_across_batches(spark, tmp_path, three_days, channels):
    folder, _ = three_days
    failures.use_rocksdb(spark)
    try:
        stream = failures.new_failure_stream(stream_of(spark, folder, schemas.EVENTS), channels, SMALL, "1 hour")
        got = run.append_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).orderBy("hour_ts").collect()
    finally:
        spark.conf.unset(failures.PROVIDER_KEY)
    assert [(r["channel_id"], r["hour_ts"]) for r in got] == [(1, at(5)), (1, at(45))]


def test_guard_state_stream(spark, tmp_path):
    events = events_frame(spark, [(1, at(1), False, None, "На охране"), (1, at(5), False, None, "Снято с охраны"),
                                  (1, at(3), False, None, "На охране"), (2, at(2), False, None, "На охране"),
                                  (2, at(2.5), False, None, "Снято с охраны")])
    folder = str(tmp_path / "in")
    write_parts(events, folder, [F.col("event_id") < 2, F.col("event_id") >= 2])
    guards = channels_frame(spark, [(1, "Состояние охраны", "x", 1), (2, "Состояние охраны", "x", 2)])
    run.update_log(windows.guard_stream(stream_of(spark, folder, schemas.EVENTS), guards, SMALL), str(tmp_path / "log"), str(tmp_path / "cp"))
    got = run.latest_of_log(spark, str(tmp_path / "log"), ["object_id"]).collect()
    assert {r["object_id"]: r["guard_on"] for r in got} == {1: 0, 2: 1}


def wire(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"events": events}, ensure_ascii=False) + "\n", encoding="utf-8")


def test_ingest_over_several_runs(spark, tmp_path):
    landing, house, checkpoint = tmp_path / "wire", str(tmp_path / "house"), str(tmp_path / "cp")
    dims = channels_frame(spark, [(1, SMOKE, "ПК 1", 1), (2, SMOKE, "ПК 2", 2), (3, SMOKE, "x", None)])
    job = ingest.AlarmIngest(dims, house, SMALL)

    def go():
        alarms = wire_alarms(wire_stream(spark, str(landing), max_files=1))
        query = ingest.start_ingest(alarms, job, checkpoint, available_now=True)
        query.awaitTermination()
        return query

    wire(landing, "a.json", [
        {"event_id": 1, "channel_id": 1, "event_ts": "2024-01-01T00:00:00", "value": FIRE},
        {"event_id": 2, "channel_id": 9, "event_ts": "2024-01-01T00:00:00", "value": FIRE},
        {"event_id": 3, "channel_id": 2, "event_ts": "2024-01-01T01:00:00", "alarm": False, "value": "5"},
        {"channel_id": 2, "event_ts": "2024-01-01T02:00:00", "value": FIRE}])
    query = go()
    assert ingest.progress_rows(query).filter("within_slo").count() >= 1
    mart = alarm_store.stored_alarms(spark, house)
    assert mart.count() == 2 and mart.filter("event_id > 100").count() == 1
    assert spark.read.parquet(f"{house}/rejects").count() == 1
    assert {r["object_id"] for r in ingest.current_rule_predictions(spark, house).collect()} == {1, 2}

    # A repeat of event 1, a late alarm outside the horizon, and newer alarms of object 1 only.
    wire(landing, "b.json", [
        {"event_id": 1, "channel_id": 1, "event_ts": "2024-01-01T00:00:00", "value": FIRE},
        {"event_id": 10, "channel_id": 1, "event_ts": "2024-01-05T00:00:00", "value": FIRE},
        {"event_id": 11, "channel_id": 3, "event_ts": "2024-01-05T00:00:00", "value": FIRE}])
    wire(landing, "c.json", [{"event_id": 12, "channel_id": 1, "event_ts": "2024-01-01T05:00:00", "value": FIRE}])
    go()
    mart = alarm_store.stored_alarms(spark, house)
    assert sorted(r["event_id"] for r in mart.filter("event_id < 100").collect()) == [1, 10, 11, 12]
    now = ingest.current_rule_predictions(spark, house)
    one = score_alarms(mart, dims, SMALL, spark.createDataFrame([(1,)], "object_id long"))
    assert [tuple(r) for r in now.filter("object_id = 1").select(*one.columns).collect()] == [tuple(r) for r in one.collect()]
    # Object 2 was not touched, so its earlier prediction stays.
    assert now.filter("object_id = 2").count() == 1
    assert spark.read.parquet(f"{house}/batches").filter("within_slo").count() >= 2


def test_same_batch_twice_adds_nothing(spark, tmp_path):
    house = str(tmp_path / "house")
    dims = channels_frame(spark, [(1, SMOKE, "ПК 1", 1)])
    batch = spark.createDataFrame([(1, 1, at(0), FIRE, None, FIRE), (1, 1, at(0), FIRE, None, FIRE)], schemas.ALARMS)
    job = ingest.AlarmIngest(dims, house, SMALL)
    for _ in range(2):
        job(batch, 0)
    assert alarm_store.stored_alarms(spark, house).count() == 1
    assert ingest.current_rule_predictions(spark, house).count() == 1
