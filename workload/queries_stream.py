"""Stream jobs over the given events, checked against the batch result of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.config import RISKS
from undercroft.operators.normalize import clean_channels
from undercroft.plans import alarm_store
from undercroft.session import fresh_path, stage
from undercroft.streaming import corrections, failures, ingest, monitor, run, tally_log, windows
from undercroft.streaming.sources import file_stream, with_event_time
from workload.binding import CONFIG, VIEWS, Tables
from workload.oracles import rd
from workload.registry import query

def event_stream(t: Tables):
    """The bound events as a stream of the given files."""
    raw = file_stream(t.spark, f"{t.sf_dir}/events.parquet*", t.base("events").schema)
    raw.createOrReplaceTempView("undercroft_event_stream")
    text = VIEWS["b_events"].replace("FROM events", "FROM undercroft_event_stream")
    return with_event_time(t.spark.sql(text))


def static_channels(t: Tables):
    """The channel table as a written table, read anew by every micro-batch."""
    return stage(clean_channels(t.channels), "channels")


def late_event_stream(t: Tables) -> tuple:
    """The bound events landed in two goes, the second older than most of the first, as a stream of the landing folder.

    Returns the stream and a function that lands the second part.
    """
    folder = fresh_path(t.spark, "landing")
    events = t.events
    late = F.hour("event_ts") % 3 == 1
    events.filter(~late).write.parquet(f"{folder}/part1")
    stream = file_stream(t.spark, f"{folder}/part*", events.schema)
    return stream, lambda: events.filter(late).write.parquet(f"{folder}/part2")


def logged_tallies(t: Tables):
    """Merged tallies of the events, a third of which come after newer ones in a run of their own."""
    stream, land = late_event_stream(t)
    path, checkpoint = fresh_path(t.spark, "tallies"), fresh_path(t.spark, "cp")
    tally_log.run_tallies(stream, CONFIG, path, checkpoint)
    land()
    tally_log.run_tallies(stream, CONFIG, path, checkpoint)
    return tally_log.merged_tallies(t.spark, path)


@query(
    "stream_hourly",
    f"""SELECT e.channel_id, date_trunc('hour', e.event_ts) AS hour_ts, count(*) AS n_events,
               count_if(is_alarm) AS n_alarms, {rd('avg(value_num)', 'value_mean')}, min(value_num) AS value_min,
               max(value_num) AS value_max
        FROM b_events e JOIN b_channels c ON c.id = e.channel_id
        WHERE c.sensor_type IN ('temp', 'heat', 'flood', 'pump', 'fan')
        GROUP BY e.channel_id, date_trunc('hour', e.event_ts)""",
)
def stream_hourly(t: Tables):
    return tally_log.hourly_mart(logged_tallies(t), t.channels, CONFIG)


@query(
    "stream_rolling",
    f"""SELECT f.object_id, w.h AS hour_ts, CAST(sum(f.n) AS BIGINT) AS ev_24h,
               {", ".join(f"CAST(sum(f.{r}) AS BIGINT) AS {r}_24h" for r in RISKS)}
        FROM (SELECT object_id, h, count(*) AS n, {", ".join(f"count_if({r}) AS {r}" for r in RISKS)}
              FROM o_flag GROUP BY object_id, h) f
        JOIN (SELECT unnest(generate_series(min(h), max(h) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS h FROM o_flag) w
          ON f.h <= w.h AND f.h > w.h - INTERVAL 24 HOUR
        GROUP BY f.object_id, w.h""",
)
def stream_rolling(t: Tables):
    return tally_log.rolling_counts(logged_tallies(t), t.channels, CONFIG)


@query(
    "stream_guard_state",
    """SELECT object_id, h AS hour_ts, guard_on FROM (
           SELECT c.object_id, date_trunc('hour', e.event_ts) AS h, max(CAST(e.value_cat = 'click' AS INTEGER)) AS guard_on,
                  row_number() OVER (PARTITION BY c.object_id ORDER BY date_trunc('hour', e.event_ts) DESC) AS rn
           FROM b_events e JOIN b_channels c ON c.id = e.channel_id
           WHERE c.sensor_type = 'guard' AND c.object_id IS NOT NULL
           GROUP BY c.object_id, date_trunc('hour', e.event_ts)) g WHERE rn = 1""",
)
def stream_guard_state(t: Tables):
    return tally_log.guard_state(logged_tallies(t), t.channels, CONFIG)


@query("stream_new_failures", "SELECT channel_id, object_id, h AS hour_ts FROM o_newfail")
def stream_new_failures(t: Tables):
    return tally_log.new_failures(logged_tallies(t), t.channels, CONFIG)


@query("stream_late_alarms", "SELECT * FROM o_alarms")
def stream_late_alarms(t: Tables):
    """Alarms in two goes: the second holds older ones and repeats a part of the first."""
    folder, house, checkpoint = (fresh_path(t.spark, x) for x in ("landing", "warehouse", "cp"))
    rows = t.events.filter("is_alarm")
    late = F.hour("event_ts") % 3 == 1
    stream = file_stream(t.spark, f"{folder}/part*", rows.schema)
    job = ingest.AlarmIngest(static_channels(t), house, CONFIG)
    rows.filter(~late).write.parquet(f"{folder}/part1")
    ingest.start_ingest(stream, job, checkpoint, available_now=True).awaitTermination()
    rows.filter(late | (F.hour("event_ts") % 3 == 2)).write.parquet(f"{folder}/part2")
    ingest.start_ingest(stream, job, checkpoint, available_now=True).awaitTermination()
    return alarm_store.stored_alarms(t.spark, house).drop("day", "batch")


@query(
    "stream_batches",
    """SELECT count(*) AS received, count_if(channel_id % 20 = 1) AS rejected, true AS within_slo FROM o_alarms""",
)
def stream_batches(t: Tables):
    """What the ingest job logged: alarms received and rejected, and whether every batch met the latency goal."""
    log = t.spark.read.parquet(f"{ingested(t)}/batches")
    return log.agg(F.sum("received").alias("received"), F.sum("rejected").alias("rejected"), F.min("within_slo").alias("within_slo"))


def ingested(t: Tables) -> str:
    """Runs the ingest job over all alarms; returns its warehouse folder.

    Channels 1, 21, 41, … are left out of the channel table, so their alarms must be rejected.
    """
    alarms = event_stream(t).filter("is_alarm")
    channels = static_channels(t).filter(F.col("id") % 20 != 1)
    warehouse = fresh_path(t.spark, "warehouse")
    job = ingest.AlarmIngest(channels, warehouse, CONFIG)
    ingest.start_ingest(alarms, job, fresh_path(t.spark, "cp"), available_now=True).awaitTermination()
    return warehouse


@query("stream_alarm_mart", "SELECT * FROM o_alarms WHERE channel_id % 20 <> 1")
def stream_alarm_mart(t: Tables):
    return alarm_store.stored_alarms(t.spark, ingested(t)).drop("day", "batch")


@query("stream_rejects", "SELECT * FROM o_alarms WHERE channel_id % 20 = 1")
def stream_rejects(t: Tables):
    return t.spark.read.parquet(f"{ingested(t)}/rejects").drop("batch")


@query(
    "stream_rescore",
    "SELECT * FROM o_rule_preds",
    extra={
        "o_alarms": """SELECT event_id, channel_id, event_ts, value_raw, value_num, value_cat FROM b_events
                       WHERE is_alarm AND channel_id % 20 <> 1"""
    },
)
def stream_rescore(t: Tables):
    return ingest.current_rule_predictions(t.spark, ingested(t))


@query(
    "stream_progress",
    """SELECT CAST(late AS BIGINT) AS batch_id, count(*) AS input_rows, true AS within_slo
       FROM (SELECT hour(event_ts) % 3 = 1 AS late FROM b_events) e GROUP BY late""",
)
def stream_progress(t: Tables):
    """What the listener wrote about two runs of a stream: one row a batch."""
    stream, land = late_event_stream(t)
    path, checkpoint, progress = (fresh_path(t.spark, x) for x in ("tallies", "cp", "progress"))
    listener = monitor.ProgressListener(t.spark, progress, ingest.SLO_SECONDS)
    tally_log.run_tallies(stream, CONFIG, path, checkpoint)
    land()
    tally_log.run_tallies(stream, CONFIG, path, checkpoint)
    listener.close()
    # Other streams of the session may have run meanwhile.
    mine = monitor.progress_rows(t.spark, progress)
    first = mine.groupBy("query_id").agg(F.sum("input_rows").alias("n")).orderBy(F.desc("n")).limit(1).select("query_id")
    return mine.join(first, "query_id", "left_semi").select("batch_id", "input_rows", "within_slo")


@query("stream_failure_corrections", "SELECT channel_id, object_id, h AS hour_ts FROM o_newfail")
def stream_failure_corrections(t: Tables):
    """New failures from keyed state, a third of the events being late by up to the whole month: answers are mended."""
    stream, land = late_event_stream(t)
    path, checkpoint = fresh_path(t.spark, "answers"), fresh_path(t.spark, "cp")
    found = corrections.failure_corrections(stream, static_channels(t), CONFIG, reach_hours=24 * 62)
    with failures.rocksdb(t.spark):
        corrections.run_corrections(found, path, checkpoint)
        land()
        corrections.run_corrections(found, path, checkpoint)
    return corrections.current_failures(t.spark, path)


@query(
    "stream_guard_updates",
    """SELECT object_id, h AS hour_ts, guard_on FROM (
           SELECT c.object_id, date_trunc('hour', e.event_ts) AS h, max(CAST(e.value_cat = 'click' AS INTEGER)) AS guard_on,
                  row_number() OVER (PARTITION BY c.object_id ORDER BY date_trunc('hour', e.event_ts) DESC) AS rn
           FROM b_events e JOIN b_channels c ON c.id = e.channel_id
           WHERE c.sensor_type = 'guard' AND c.object_id IS NOT NULL
           GROUP BY c.object_id, date_trunc('hour', e.event_ts)) g WHERE rn = 1""",
)
def stream_guard_updates(t: Tables):
    """Guard state in update mode: late events of the newest hour change what was told before."""
    stream, land = late_event_stream(t)
    path, checkpoint = fresh_path(t.spark, "guards"), fresh_path(t.spark, "cp")
    found = windows.guard_stream(stream, static_channels(t), CONFIG)
    run.update_log(found, path, checkpoint)
    land()
    run.update_log(found, path, checkpoint)
    return run.latest_of_log(t.spark, path, ["object_id"])


@query(
    "newest_stored_alarms",
    "SELECT * FROM o_alarms QUALIFY row_number() OVER (ORDER BY event_ts DESC, event_id DESC) <= 50",
)
def newest_stored_alarms(t: Tables):
    """The report of the 50 newest alarms, from the newest day folders of the stored mart."""
    house = fresh_path(t.spark, "house")
    alarm_store.load_alarms(t.events.filter("is_alarm"), house)
    return alarm_store.newest_alarms(t.spark, house, 50)
