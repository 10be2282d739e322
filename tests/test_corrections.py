"""Keyed state that mends its answers, and the table of stream progress."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, at, channels_frame, events_frame
from undercroft import schemas
from undercroft.streaming import corrections, failures, monitor
from undercroft.streaming.sources import file_stream


def test_answers():
    assert corrections.answers([1, 2, 26, 27, 52], 24) == {1: True, 2: False, 26: False, 27: False, 52: True}
    assert corrections.answers([], 24) == {}


def batch_answers(hours, quiet=24):
    return {(c, h) for c, hs in hours.items() for h, fresh in corrections.answers(sorted(set(hs)), quiet).items() if fresh}


def run_parts(spark, folder, parts, channels, reach, path, checkpoint):
    """Feeds parts of (channel, hour) one after the other, each in a run of its own."""
    with failures.rocksdb(spark):
        for i, part in enumerate(parts):
            rows = [(c, at(h), False, None, "Неисправен") for c, h in part] + [(1, at(0), False, 5.0, None)]
            events_frame(spark, rows).coalesce(1).write.parquet(f"{folder}/part{i}")
            stream = file_stream(spark, f"{folder}/part*", schemas.EVENTS)
            corrections.run_corrections(corrections.failure_corrections(stream, channels, SMALL, reach), path, checkpoint)


@pytest.mark.parametrize("seed", [1, 2])
def test_late_events_mend_answers(spark, tmp_path, seed):
    rnd = random.Random(seed)
    channels = channels_frame(spark, [(1, "x", "ПК 1", 1), (2, "x", "ПК 2", 1), (3, "x", "ПК 3", None)])
    rows = [(rnd.choice([1, 2, 3]), rnd.randrange(0, 300)) for _ in range(60)]
    parts = [rows[i::3] for i in range(3)]
    path = str(tmp_path / "log")
    run_parts(spark, str(tmp_path / "in"), parts, channels, 400, path, str(tmp_path / "cp"))
    got = {(r["channel_id"], r["hour_ts"]) for r in corrections.current_failures(spark, path).collect()}
    want = batch_answers({c: [h for k, h in rows if k == c] for c in (1, 2)})
    assert got == {(c, at(h)) for c, h in want}
    assert corrections.too_late(spark, path).count() == 0


def test_state_is_bounded_and_nothing_is_dropped_unseen(spark, tmp_path):
    channels = channels_frame(spark, [(1, "x", "ПК 1", 1)])
    path = str(tmp_path / "log")
    # Hour 60 comes late but within reach: hour 70 is no new failure any more. Hour 5 comes too late.
    parts = [[(1, h) for h in (10, 70, 100)], [(1, 60), (1, 5)], [(1, 300)], [(1, 200), (1, 60), (1, 279)]]
    run_parts(spark, str(tmp_path / "in"), parts, channels, 50, path, str(tmp_path / "cp"))
    answers = {(r["hour_no"] - 473352, r["fresh"]) for r in corrections.answer_log(spark, path).merged().where("not too_late").collect()}
    assert answers == {(10, True), (60, True), (70, False), (100, True), (300, False), (279, True)}
    assert sorted(r["hour_ts"] for r in corrections.too_late(spark, path).collect()) == [at(5), at(60), at(200)]


class _List:
    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def test_the_state_holds_the_last_hours_only():
    import pandas as pd

    state = corrections.FailureHours(24, 50)
    state.hours = _List()
    for start in range(0, 5000, 10):
        rows = pd.DataFrame({"channel_id": 1, "object_id": 1, "hour_no": range(start, start + 10)})
        list(state.handleInputRows((1,), iter([rows]), None))
        assert len(state.hours.rows) <= 50 + 24 + 1


def test_progress_of_streams_becomes_a_table(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "progress")
    listener = monitor.ProgressListener(spark, path, slo_seconds=300)
    strict = monitor.ProgressListener(spark, str(tmp_path / "strict"), slo_seconds=0)
    for i, n in enumerate((5, 3, 4)):
        spark.range(n).write.parquet(f"{folder}/part{i}")
        stream = file_stream(spark, f"{folder}/part*", spark.range(1).schema)
        query = (stream.writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "cp"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    listener.close()
    strict.close()
    rows = monitor.progress_rows(spark, path).where("name = 'counted'").orderBy("batch_id").collect()
    assert [(r["batch_id"], r["input_rows"], r["within_slo"]) for r in rows] == [(0, 5, True), (1, 3, True), (2, 4, True)]
    assert len({r["query_id"] for r in rows}) == 1 and len({r["run_id"] for r in rows}) == 3
    assert monitor.progress_rows(spark, str(tmp_path / "strict")).where("within_slo").count() == 0
    # A batch that ran again counts once.
    log = monitor.progress_log(spark, path)
    again = monitor.progress_rows(spark, path).withColumn("started_at", F.col("started_at") + F.expr("INTERVAL 1 DAY"))
    log.add(again.withColumn("seconds", F.lit(9.0)), "again", 0)
    assert [r["seconds"] for r in monitor.progress_rows(spark, path).where("name = 'counted'").collect()] == [9.0] * 3
