"""The levelled log: bounded parts, exactly once, readers that stay with their manifest."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, at, channels_frame, events_frame
from undercroft.operators.tallies import channel_hour_tallies
from undercroft.sources import snapshots
from undercroft.streaming import tally_log
from undercroft.streaming.level_log import LevelLog


def add_up(rows):
    return rows.groupBy("day", "key").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def batch(spark, i):
    return spark.range(3).select(F.lit(f"d{i % 2}").alias("day"), (F.col("id") + i % 4).alias("key"), F.lit(1).cast("long").alias("n"),
                                 F.lit(i).cast("long").alias("top")).select("day", "key", "n", "top")


def files_of(spark, frame):
    return len(frame.inputFiles())


def test_parts_stay_few_however_many_batches(spark, tmp_path):
    log = LevelLog(spark, str(tmp_path / "log"), add_up, ["day"], fan=4)
    most = 0
    for i in range(100):
        assert log.add(batch(spark, i).coalesce(1), "s", i)
        most = max(most, len(log.manifest().parts))
    assert most <= 3 * 4
    assert files_of(spark, log.rows()) <= 2 * most
    # Parts on disk are those of the kept manifests and no more.
    assert len(snapshots.child_names(spark, f"{log.path}/parts")) <= 4 * most
    assert len(snapshots.child_names(spark, f"{log.path}/manifest")) == 3
    want = {}
    for i in range(100):
        for key in range(3):
            k = (f"d{i % 2}", key + i % 4)
            n, top = want.get(k, (0, 0))
            want[k] = (n + 1, max(top, i))
    got = {(r["day"], r["key"]): (r["n"], r["top"]) for r in log.merged().collect()}
    assert got == want
    only = {(r["day"], r["key"]): (r["n"], r["top"]) for r in log.merged(F.col("day") == "d1").collect()}
    assert only == {k: v for k, v in want.items() if k[0] == "d1"}
    plan = log.rows().where("day = 'd1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_batches_count_once_whatever_breaks(spark, tmp_path, monkeypatch):
    log = LevelLog(spark, str(tmp_path / "log"), add_up, ["day"], fan=2)
    write = snapshots.write_text
    for i in range(7):
        def broken(*args):
            raise OSError("lost")
        monkeypatch.setattr(snapshots, "write_text", broken)
        with pytest.raises(OSError):
            log.add(batch(spark, i), "s", i)
        monkeypatch.setattr(snapshots, "write_text", write)
        assert log.add(batch(spark, i), "s", i)
        assert not log.add(batch(spark, i), "s", i)
    # Another stream has batches of the same numbers.
    assert log.add(batch(spark, 0), "other", 0) and not log.add(batch(spark, 0), "other", 0)
    assert log.merged().agg(F.sum("n")).first()[0] == 8 * 3
    assert log.holds("s", 6) and not log.holds("s", 7) and not log.holds("third", 0)


def test_a_reader_keeps_its_manifest(spark, tmp_path):
    log = LevelLog(spark, str(tmp_path / "log"), add_up, ["day"], fan=2)
    with pytest.raises(ValueError, match="nothing was written"):
        log.rows()
    log.add(batch(spark, 0), "s", 0)
    early = log.merged()
    log.add(batch(spark, 1), "s", 1)
    log.add(batch(spark, 2).limit(0), "s", 2)
    assert early.agg(F.sum("n")).first()[0] == 3
    assert log.merged().agg(F.sum("n")).first()[0] == 6


def test_tallies_of_many_batches_equal_those_of_all_events(spark, tmp_path):
    rows = [(c, at(h + c / 10), h % 3 == 0, float(h * c), "На охране" if h % 5 == 0 else None) for h in range(60) for c in (1, 2, 3)]
    events = events_frame(spark, rows)
    channels = channels_frame(spark, [(1, "Датчик температуры", "ПК 1", 1), (2, "Состояние охраны", "ПК 2", 1), (3, "Датчик дыма", "x", 2)])
    path = str(tmp_path / "log")
    for i in range(12):
        part = events.where(F.pmod(F.hash("event_id"), F.lit(12)) == i)
        assert tally_log.add_tallies(part, SMALL, path, "s", i)
        assert not tally_log.add_tallies(part, SMALL, path, "s", i)
    merged = tally_log.merged_tallies(spark, path)
    whole = channel_hour_tallies(events, SMALL, F.min("value_num").alias("num_min")).select(*merged.columns)
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))
    late = tally_log.merged_tallies(spark, path, "2024-01-03")
    assert late.count() == 12 * 3
    assert tally_log.guard_state(merged, channels, SMALL).count() == 1
    # A batch is scanned once: one aggregate, no join.
    plan = tally_log.batch_tallies(events, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
