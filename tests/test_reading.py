"""Reads that leave out what they need not see: ancestors by doubling, newest days, row groups of other channels."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from undercroft import schemas
from undercroft.operators import hierarchy, rows
from undercroft.plans import alarm_store, jobs
from undercroft.sources import tables


def scan_metric(frame, name):
    """A figure of the scan after the frame was read: files opened, or rows given after row groups were left out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan).collectLeaves()
    return leaves.head().metrics().apply(name).value()


def test_ancestors_of_a_deep_chain_take_few_rounds(spark, monkeypatch):
    n = 1000
    objects = spark.createDataFrame([(i, i, i - 1 if i > 1 else None, "k", f"n{i}") for i in range(1, n + 1)], schemas.OBJECTS)
    written = []
    stage = hierarchy.stage
    monkeypatch.setattr(hierarchy, "stage", lambda df, tag: written.append(tag) or stage(df, tag))
    deepest = hierarchy.ancestors(objects, spark.createDataFrame([(n,), (2,), (1,)], "object_id long")).collect()
    assert written.count("ancestors") <= 11
    got = {(r["object_id"], r["distance"], r["ancestor_id"], r["level"]) for r in deepest}
    assert got == {(n, d, n - d, n - d) for d in range(1, n)} | {(2, 1, 1, 1)}
    assert len(deepest) == n


def test_ancestors_of_cycles_and_strays(spark):
    parents = {1: 2, 2: 3, 3: 4, 4: 2, 5: 5, 6: 0, 7: None, 8: 99, 9: 8}
    objects = spark.createDataFrame([(i, 1, p, "k", "n") for i, p in parents.items()], schemas.OBJECTS)
    want = set()
    for start in parents:
        met, at_, d = [], parents[start], 1
        while at_ and at_ in parents and at_ not in met:
            want.add((start, d, at_))
            met.append(at_)
            at_, d = parents[at_], d + 1
    got = {(r["object_id"], r["distance"], r["ancestor_id"]) for r in hierarchy.ancestors(objects).collect()}
    assert got == want
    assert hierarchy.ancestors(objects.limit(0)).count() == 0


def alarms(spark, days, per_day):
    n = days * per_day
    time = F.timestamp_add("MINUTE", (F.floor(F.col("id") / per_day) * 1440 + F.col("id") % per_day).cast("int"), F.lit(at(0)).cast("timestamp_ntz"))
    return spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("channel_id"), time.alias("event_ts"),
                                 F.lit("v").alias("value_raw"), F.lit(None).cast("double").alias("value_num"), F.lit("v").alias("value_cat"))


@pytest.mark.parametrize("n, channel", [(50, None), (12, None), (500, None), (7, 1), (1000, 2)])
def test_newest_alarms_read_few_days(spark, tmp_path, n, channel):
    house = str(tmp_path / "house")
    rows_ = alarms(spark, 40, 12)
    alarm_store.load_alarms(rows_, house)
    found = alarm_store.newest_alarms(spark, house, n, channel)
    wanted = rows_ if channel is None else rows_.where(F.col("channel_id") == channel)
    want = [r["event_id"] for r in wanted.orderBy(F.desc("event_ts"), F.desc("event_id")).limit(n).collect()]
    assert [r["event_id"] for r in found.collect()] == want
    if n <= 50:
        # Eight days at most hold fifty alarms of twelve a day, twice as many being taken each time.
        assert scan_metric(found, "numFiles") <= 8 < 40


def test_newest_of_an_empty_store(spark, tmp_path):
    assert alarm_store.newest_alarms(spark, str(tmp_path), 5).count() == 0


def test_clustered_files_skip_row_groups_of_other_channels(spark, tmp_path):
    source, target = str(tmp_path / "events"), str(tmp_path / "clustered")
    n = 200_000
    events = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(500)).alias("channel_id"), F.lit(2024).alias("year"),
                                   F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit(at(0)).cast("timestamp_ntz")).alias("event_ts"))
    events = events.withColumnRenamed("id", "event_id")
    tables.write_table(events.repartition(4), source, ["year"])
    spark.conf.set("parquet.block.size", str(64 * 1024))
    try:
        jobs.cluster_events(spark, source, target)
    finally:
        spark.conf.unset("parquet.block.size")
    one = F.col("channel_id") == 123
    loose, tight = (spark.read.parquet(p).where(one) for p in (source, target))
    assert sorted(r["event_id"] for r in loose.collect()) == sorted(r["event_id"] for r in tight.collect())
    assert scan_metric(loose, "numOutputRows") == n
    assert scan_metric(tight, "numOutputRows") < n / 4
    meta = [pq.ParquetFile(f).metadata for f in Path(target).rglob("*.parquet")]
    assert sum(m.num_rows for m in meta) == n and spark.read.parquet(target).count() == n


def test_slices_follow_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(rows, "SLICE_ROWS", 100)
    frame = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    summed = rows.running_totals(frame, ["k"], [F.asc("id")], {"n": F.lit(1).cast("bigint"), "s": F.col("id")})
    got = {(r["k"], r["id"]): (r["n"], r["s"]) for r in summed.collect()}
    assert all(got[k, i] == ((i - k) // 2 + 1, sum(range(k, i + 1, 2))) for k in (0, 1) for i in range(k, 1000, 2))
    assert rows.running_totals(frame.limit(0), ["k"], [F.asc("id")], {"n": F.lit(1)}).count() == 0
