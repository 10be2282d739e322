"""The physical plans must keep the shape that scales."""

import re

import pytest

from tests.conftest import SMALL
from undercroft.operators import feedback, marts, rows
from undercroft.operators.normalize import clean_channels
from undercroft.operators.alarm_risk import score_alarms
from undercroft.operators.tallies import channel_hour_tallies
from undercroft.plans import panel
from workload.binding import CONFIG, Tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Events and channels as stored tables, too big to broadcast by the measure set here."""
    folder = tmp_path_factory.mktemp("tables")
    t = Tables(spark, SF)
    t.events.write.parquet(f"{folder}/events")
    t.channels.write.parquet(f"{folder}/channels")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(f"{folder}/events"), spark.read.parquet(f"{folder}/channels")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tallies_read_few_columns_and_combine_before_the_shuffle(tables):
    text = plan(channel_hour_tallies(tables[0], SMALL))
    assert "value_raw" not in text and "event_id" not in text
    assert text.count("Exchange") == 1 and "partial_count" in text
    assert "PushedFilters: [IsNotNull(event_ts)" in text


def test_panel_never_moves_the_dense_grid(tables):
    """Above the gap filling there is no exchange except the broadcast of daily weather."""
    text = plan(panel.build_panel(*tables, None, CONFIG))
    above = text.split("Generate explode")[0]
    assert "Exchange" not in above
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_bounds_are_broadcast_when_nothing_is_small(tables):
    text = plan(panel.build_panel(*tables, None, CONFIG))
    assert len(re.findall("BroadcastHashJoin", text)) == 1
    assert re.search(r"BroadcastHashJoin \[period", text)


def test_hot_keys_are_limited_before_the_shuffle(tables):
    text = plan(marts.alarm_mart(tables[0]))
    assert "WindowGroupLimit" in text and "Partial" in text
    text = plan(rows.first_per_key(tables[0], ["channel_id"], [F.desc("event_ts")]))
    assert "WindowGroupLimit" in text


def test_hourly_mart_aggregates_before_it_joins(tables):
    text = plan(marts.hourly_mart(*tables, CONFIG))
    assert text.index("Join") < text.index("HashAggregate")


def test_alarm_scoring_has_no_cross_join(tables):
    events, channels = tables
    text = plan(score_alarms(marts.alarm_mart(events), clean_channels(channels), CONFIG))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_panel_does_not_depend_on_broadcasts(spark, tables):
    """Sort-merge joins give the same panel as broadcast joins."""
    t = Tables(spark, SF)
    merged = panel.build_panel(*tables, t.weather, CONFIG).drop("month_sin", "month_cos")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    left = sorted(map(str, merged.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")
    try:
        right = sorted(map(str, panel.build_panel(t.events, t.channels, t.weather, CONFIG).drop("month_sin", "month_cos").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert left == right


def test_predictions_are_never_broadcast(spark):
    """Narrow columns of a compressed table look small to Spark, so even a side that seems to fit is shuffled."""
    t = Tables(spark, SF)
    accepted, rejected = feedback.split_decisions(
        t.feedback.withColumn("decided_at", F.col("created_at")), t.predictions)
    made = [accepted, rejected, feedback.apply_decisions(t.predictions, accepted), feedback.ticket_drafts(accepted, t.predictions),
            feedback.decision_counts(t.feedback, t.predictions), feedback.feedback_labels(t.feedback, t.predictions)]
    for df in made:
        text = plan(df)
        assert "SortMergeJoin" in text and "Broadcast" not in text
