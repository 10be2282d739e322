"""Landing files: one header probe for all, rejects and later lines of uploads, wire batches that replay."""

import json

import pytest
from pyspark.sql import functions as F

from undercroft import schemas
from undercroft.plans import alarm_store, jobs
from undercroft.sources import files, tables
from undercroft.streaming.sources import wire_alarms, wire_rows
from workload import queries_files
from workload.binding import Tables

OBJECTS = "ид_объект,иерархия_уровень,родитель,вид_объекта,диспетчерское_название_объекта\n"
CHANNELS = "ид_канала_данных,тип_инж_системы,тип_датчика,тег_инженерной_системы,название_датчика,ид_объект\n"
JOURNAL = "ид_события,ид_канала_данных,дата,время,тревожное,значение_датчика\n"
SMOKE = "Обнаружен дым"


def jobs_run(spark, action):
    """What an action returns and how many Spark jobs it ran."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    before = set(sc.statusTracker().getJobIdsForGroup("counted"))
    try:
        return action(), len(set(sc.statusTracker().getJobIdsForGroup("counted")) - before)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_one_job_reads_a_thousand_headers(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for i in range(1000):
        header = (OBJECTS, CHANNELS, JOURNAL)[i % 3]
        body = "\n".join(["1,2,3,4,5,6"] * (3000 if i < 3 else 1))
        (landing / f"файл {i}.csv").write_text(header + body, encoding="utf-8")
    (landing / "empty.csv").write_text("")
    (landing / "notes.txt").write_text("not a table")
    size, cost = (spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"))
    routed, n_jobs = jobs_run(spark, lambda: files.route_folder(spark, str(landing)))
    assert n_jobs == 1
    assert {k: sum(map(len, h.values())) for k, h in routed.items()} == {"objects": 334, "channels": 333, "journal": 333}
    assert (size, cost) == tuple(spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"))


def test_unknown_and_missing_headers_name_the_file(spark, tmp_path):
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="odd.csv"):
        files.route_folder(spark, str(tmp_path))
    blank = tmp_path / "blank"
    blank.mkdir()
    (blank / "x.csv").write_text("\n1,2\n")
    with pytest.raises(ValueError, match="without a header"):
        files.route_folder(spark, str(blank))
    (blank / "none.csv").write_text("")
    with pytest.raises(ValueError, match="without a header"):
        files.read_header(spark, str(blank / "none.csv"))
    assert files.route_files(spark, []) == {}


def test_the_last_line_of_an_upload_counts(spark, tmp_path):
    house = str(tmp_path / "house")
    (tmp_path / "a.csv").write_text(OBJECTS + "1,1,,k,zzz\n2,1,,k,first\n1,1,,k,middle\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(
        "диспетчерское_название_объекта,вид_объекта,родитель,иерархия_уровень,ид_объект\naaa,k,2,2,1\n", encoding="utf-8")
    kind, n = jobs.import_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], house)
    stored = {r["id"]: (r["name"], r["parent_id"]) for r in tables.read_table(spark, f"{house}/objects").collect()}
    assert (kind, n) == ("objects", 4) and stored == {1: ("aaa", 2), 2: ("first", None)}
    (tmp_path / "c.csv").write_text(CHANNELS + "5,s,t,,n1,1\n5,s,t,,a2,9\n", encoding="utf-8")
    jobs.import_files(spark, [str(tmp_path / "c.csv")], house)
    assert [tuple(r) for r in tables.read_table(spark, f"{house}/channels").select("id", "name", "object_id").collect()] == [(5, "a2", None)]


def test_rejects_of_every_upload_stay(spark, tmp_path):
    house, path = str(tmp_path / "house"), tmp_path / "same.csv"
    for line in ("1,1", "2,1,,k,a,b"):
        path.write_text(OBJECTS + f"7,1,,k,n\n{line}\n", encoding="utf-8")
        jobs.import_files(spark, [str(path)], house)
    rejects = tables.read_table(spark, f"{house}/rejected_lines")
    assert sorted(r["line"] for r in rejects.collect()) == ["1,1", "2,1,,k,a,b"]
    assert rejects.select("file").distinct().count() == 1 and rejects.select("upload").distinct().count() == 2


def test_dimension_load_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "o.csv").write_text("﻿" + OBJECTS + "1,1,,k,n\n2,1\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text(CHANNELS + "5,s,t,,n,1,9,9\n6,s,t,,n,1\n", encoding="utf-8")
    house = str(tmp_path / "house")
    for _ in range(2):
        jobs.load_dimensions(spark, str(tmp_path / "o.csv"), str(tmp_path / "c.csv"), house)
        got = {(r["file"], r["line"]) for r in tables.read_table(spark, f"{house}/dimension_rejects").collect()}
        assert got == {("o.csv", "2,1"), ("c.csv", "5,s,t,,n,1,9,9")}
        assert tables.read_table(spark, f"{house}/objects").columns == schemas.OBJECTS.names
        assert tables.read_table(spark, f"{house}/channels").count() == 1


def alarms(spark, ids, hour=0):
    rows = spark.createDataFrame([(i,) for i in ids], "event_id long")
    time = F.timestamp_add("HOUR", (F.col("event_id") % 50 + hour).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return rows.select("event_id", F.lit(1).cast("long").alias("channel_id"), time.alias("event_ts"), F.lit(SMOKE).alias("value_raw"),
                       F.lit(None).cast("double").alias("value_num"), F.lit(SMOKE).alias("value_cat"))


def stored(spark, house):
    return sorted(r["event_id"] for r in alarm_store.stored_alarms(spark, house).collect())


def test_an_upload_cut_short_is_completed_by_the_next(spark, tmp_path, monkeypatch):
    house = str(tmp_path / "house")
    alarm_store.load_alarms(alarms(spark, range(5)), house)
    write_keys = alarm_store._write_keys

    def broken(*args):
        raise OSError("lost")
    monkeypatch.setattr(alarm_store, "_write_keys", broken)
    with pytest.raises(OSError):
        alarm_store.upload_alarms(alarms(spark, range(3, 10)), house)
    monkeypatch.setattr(alarm_store, "_write_keys", write_keys)
    assert stored(spark, house) == list(range(10))
    alarm_store.upload_alarms(alarms(spark, range(0, 12)), house)
    assert stored(spark, house) == list(range(12))
    assert alarm_store.heal_uploads(spark, house) == []


def test_batches_that_run_again_after_compaction_add_nothing(spark, tmp_path):
    house = str(tmp_path / "house")
    batches = [alarms(spark, range(5 * i, 5 * i + 8)) for i in range(4)]

    def run(i):
        alarm_store.add_alarms(alarm_store.new_alarms(batches[i], house, i), house, i)
    for i in range(4):
        run(i)
        run(i)
    alarm_store.upload_alarms(alarms(spark, range(20, 30)), house)
    assert stored(spark, house) == list(range(30))
    assert jobs.compact_alarms(spark, house, keep=1) > 0
    assert alarm_store.stored_batches(spark, house) == {alarm_store.BULK, 3}
    assert alarm_store.stored_batches(spark, house, alarm_store.KEYS) == {alarm_store.BULK, 3}
    for i in (0, 1, 2, 3, 3):
        run(i)
        assert stored(spark, house) == list(range(30))
    jobs.compact_alarms(spark, house, keep=0)
    run(3)
    assert alarm_store.upload_alarms(alarms(spark, range(31)), house) < alarm_store.BULK - 1
    assert stored(spark, house) == list(range(31))
    assert jobs.compact_alarms(spark, str(tmp_path / "none")) == 0


def test_wire_rows_without_id_and_time_keep_their_ids(spark, tmp_path):
    landing, house = tmp_path / "wire", str(tmp_path / "house")
    landing.mkdir()
    events = [{"channel_id": 1, "value": "a"}, {"channel_id": 1, "value": "a"}, {"channel_id": 1, "event_ts": "2024-01-01T00:00:00", "value": "a"},
              {"event_id": 7, "channel_id": 1, "value": "a"}, {"event_id": 0, "channel_id": 2, "alarm": True}, {"channel_id": 3, "alarm": False}]
    line = json.dumps({"events": events})
    (landing / "a.json").write_text(f"{line}\nnot json\n{{\"events\": []}}\n{line}\n")
    (landing / "b.json").write_text(f"{line}\n")

    def ids():
        return sorted(r["event_id"] for r in wire_alarms(wire_rows(spark, str(landing))).collect())
    first = ids()
    assert first == ids() and len(first) == 15
    # Both files: event 7 and the one with a time are the same event; the others stand for themselves in each file.
    assert len(set(first)) == 2 + 3 * 2
    for _ in range(2):
        alarm_store.upload_alarms(wire_alarms(wire_rows(spark, str(landing))), house)
        assert len(stored(spark, house)) == 8


def test_landed_object_is_none_of_the_given(spark):
    """Its id is free however many suppliers there are, so the folder holds one object more than the tables."""
    landed = int(queries_files.BROKEN_OBJECTS[1].split(",")[0])
    given = Tables(spark, "/root/testdata/sf0.1").objects
    assert given.where((F.col("id") == landed) | (F.col("parent_id") == landed)).isEmpty()
