"""Files as they arrive: the given tables written as landing files, read back by the file operators and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft import schemas
from undercroft.operators import hierarchy
from undercroft.operators.audit import audit_rows
from undercroft.operators.normalize import clean_channels
from undercroft.plans import alarm_store, dispatch_jobs, jobs
from undercroft.schemas import CHANNEL_HEADER, JOURNAL_HEADER, OBJECT_HEADER
from undercroft.session import fresh_path
from undercroft.sources import files
from undercroft.sources.tables import read_table
from undercroft.streaming.sources import wire_alarms, wire_rows
from workload.binding import CONFIG, Tables
from workload.registry import query


def land(rows: DataFrame, header: dict[str, str], folder: str, order: list[str] | None = None, **options: str) -> None:
    """Writes rows as CSV files under the journal's own column names, in the given order of columns."""
    raw = {ours: name for name, ours in header.items()}
    named = rows.select(*[F.col(c).alias(raw[c]) for c in (order or list(header.values()))])
    named.write.options(header="true", **{"escape": '"', "emptyValue": "", **options}).csv(folder)


def land_broken(t: Tables, lines: list[str], folder: str) -> None:
    """A file of its own with lines that do not fit its header, and the mark some programs put before it."""
    t.spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)


#: One good line with an id that no given object has, however many there are, and two that have too few or too many fields.
BROKEN_OBJECTS = ["﻿" + ",".join(f'"{c}"' for c in OBJECT_HEADER), '3000000000000,1,,"plant"," Far, side "', "701,1", "702,1,,plant,a,b,c"]


def landing(t: Tables) -> str:
    """A landing folder with objects, channels and the journal in two column orders."""
    folder = fresh_path(t.spark, "landing")
    land(t.objects, OBJECT_HEADER, f"{folder}/objects", quoteAll="true")
    land_broken(t, BROKEN_OBJECTS, f"{folder}/objects_more.csv")
    land(t.channels, CHANNEL_HEADER, f"{folder}/channels", order=["object_id", "name", "id", "tag", "sensor_type", "system_type"])
    journal, even = t.journal_raw, F.crc32(F.coalesce("value", F.lit(""))) % 2 == 0
    land(journal.where(even), JOURNAL_HEADER, f"{folder}/journal_a")
    land(journal.where(~even), JOURNAL_HEADER, f"{folder}/journal_b", order=["value", "alarm", "time", "date", "channel_id", "event_id"])
    # Spark names text files .txt; landing files are known by .csv.
    return _as_csv(t, folder)


def _as_csv(t: Tables, folder: str) -> str:
    fs = t.spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    for status in fs.globStatus(path(f"{folder}/*/part-*.txt")):
        fs.rename(status.getPath(), path(f"{status.getPath().toString()[:-4]}.csv"))
    return folder


@query(
    "routed_import",
    """SELECT 'objects' AS kind, count(*) + 1 AS n_rows, 1 AS n_headers, 2 AS n_rejected FROM b_objects
       UNION ALL SELECT 'channels', count(*), 1, 0 FROM b_channels
       UNION ALL SELECT 'journal', count(*), 2, 0 FROM b_journal_raw""",
)
def routed_import(t: Tables):
    """What a mixed landing folder holds: files by kind, column orders, rows that fit and lines that do not."""
    routed = files.route_folder(t.spark, landing(t))
    out = None
    for kind, headers in sorted(routed.items()):
        rows, rejects = files.read_group(t.spark, headers, kind, trim=True)
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(kind).alias("kind"), "n_rows", F.lit(len(headers)).alias("n_headers"),
            F.lit(rejects.count()).alias("n_rejected"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dimension_csv",
    """SELECT o.id, o.level, p.id AS parent_id, o.kind, o.name, CAST(NULL AS VARCHAR) AS sensor_type,
               CAST(NULL AS VARCHAR) AS picket
        FROM b_objects o LEFT JOIN b_objects p ON p.id = o.parent_id
        UNION ALL SELECT id, CAST(NULL AS INTEGER), object_id, system_type, name, sensor_type, picket FROM o_mart_channels""",
)
def dimension_csv(t: Tables):
    """Both dimension files loaded by the job, as the tables then stand."""
    folder, house = landing(t), fresh_path(t.spark, "house")
    jobs.load_dimensions(t.spark, f"{folder}/objects", f"{folder}/channels", house)
    objects, channels = (read_table(t.spark, f"{house}/{n}") for n in ("objects", "channels"))
    none = F.lit(None).cast("string")
    return objects.select("id", "level", "parent_id", "kind", "name", none.alias("sensor_type"), none.alias("picket")).unionByName(
        channels.select("id", F.lit(None).cast("int").alias("level"), F.col("object_id").alias("parent_id"),
                        F.col("system_type").alias("kind"), "name", "sensor_type", "picket"))


@query("dimension_rejects", f"SELECT unnest(['{BROKEN_OBJECTS[2]}', '{BROKEN_OBJECTS[3]}']) AS line, count(*) AS n_channels FROM b_channels")
def dimension_rejects(t: Tables):
    """Lines that the dimension load set aside, beside the number of channels it loaded."""
    folder, house = landing(t), fresh_path(t.spark, "house")
    jobs.load_dimensions(t.spark, f"{folder}/objects_more.csv", f"{folder}/channels", house)
    n = read_table(t.spark, f"{house}/channels").count()
    return read_table(t.spark, f"{house}/dimension_rejects").select("line", F.lit(n).alias("n_channels"))


@query(
    "bootstrap_import",
    """SELECT event_id, channel_id, event_ts, value_raw, value_num, value_cat,
              (SELECT count(*) FROM b_objects) + 1 AS n_objects, (SELECT count(*) FROM b_channels) AS n_channels
       FROM (SELECT event_id, channel_id, event_ts, trim(value_raw) AS value_raw, value_num, value_cat,
                    row_number() OVER (PARTITION BY event_id ORDER BY event_ts, channel_id) AS rn
             FROM o_lenient WHERE is_alarm AND event_ts IS NOT NULL) a WHERE rn = 1""",
)
def bootstrap_import(t: Tables):
    """The whole landing folder imported in dependency order, twice: the second time adds nothing."""
    folder, house = landing(t), fresh_path(t.spark, "house")
    for _ in range(2):
        jobs.import_bootstrap(t.spark, folder, house)
    counts = [F.lit(read_table(t.spark, f"{house}/{n}").count()).alias(f"n_{n}") for n in ("objects", "channels")]
    return alarm_store.stored_alarms(t.spark, house).drop("day", "batch").select("*", *counts)


@query("compacted_mart", "SELECT * FROM o_alarms")
def compacted_mart(t: Tables):
    """The mart after three uploads that overlap, a compaction, and an upload of what was there before."""
    house = fresh_path(t.spark, "house")
    rows = t.events.where("is_alarm").select(*alarm_store.ALARM_COLUMNS)
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))
    for keep in (part < 2, part.isin(1, 2), part == 3):
        alarm_store.upload_alarms(rows.where(keep), house)
    jobs.compact_alarms(t.spark, house, keep=0)
    alarm_store.upload_alarms(rows, house)
    return alarm_store.stored_alarms(t.spark, house).drop("day", "batch")


@query(
    "journal_files_by_year",
    """SELECT 2023 AS year, count_if(event_id % 3 = 0) AS n_rows, CAST(sum(event_id) FILTER (WHERE event_id % 3 = 0) AS BIGINT) AS ids
       FROM o_norm UNION ALL
       SELECT 2024, count_if(event_id % 3 = 1), CAST(sum(event_id) FILTER (WHERE event_id % 3 = 1) AS BIGINT) FROM o_norm""",
)
def journal_files_by_year(t: Tables):
    """Yearly files normalised by the job; the example file, an empty file and a year not asked for are left out."""
    folder, target = fresh_path(t.spark, "years"), fresh_path(t.spark, "events")
    third = F.pmod(F.col("event_id").try_cast("long"), F.lit(3))
    for name, keep in (("ext-journal-2023", third == 0), ("ext-journal-2024", third == 1), ("ext-journal-2022", third == 2),
                       ("journal-example", third == 2)):
        land(t.journal_raw.where(keep).coalesce(1), JOURNAL_HEADER, f"{folder}/{name}")
        _rename_file(t, f"{folder}/{name}", f"{folder}/{name}.csv")
    t.spark.createDataFrame([], "value string").coalesce(1).write.text(f"{folder}/2024-empty.csv")
    jobs.journals_to_parquet(t.spark, folder, target, years=[2023, 2024])
    return read_table(t.spark, target).groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("ids"))


def _rename_file(t: Tables, folder: str, name: str) -> None:
    """The one file that Spark wrote into a folder, under a name of its own."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(t.spark._jsc.hadoopConfiguration())
    fs.rename(fs.globStatus(path(f"{folder}/part-*"))[0].getPath(), path(name))


@query(
    "wire_batch",
    """SELECT CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS event_id, channel_id,
              CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_ts END AS event_ts, value_raw, value_num, value_cat,
              (SELECT count(*) FROM b_events WHERE is_alarm) AS n_ids
       FROM (SELECT event_id, channel_id, event_ts, value_raw, CAST(value_num AS DOUBLE) AS value_num,
                    CAST(NULL AS VARCHAR) AS value_cat FROM b_events WHERE is_alarm) a""",
)
def wire_batch(t: Tables):
    """JSON batches read back: flags that default, ids and times that are filled in, and how many ids are distinct.

    What is filled in depends on the run, so it is shown as missing.
    """
    folder = fresh_path(t.spark, "wire")
    number = F.col("event_id")
    fields = [F.when(number % 5 != 0, number).alias("event_id"), F.col("channel_id"),
              F.when(number % 7 != 0, F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("event_ts"),
              F.when(~F.col("is_alarm"), F.lit(False)).alias("alarm"), F.col("value_raw").alias("value")]
    one = t.events.select(F.struct(*fields).alias("e"), F.col("event_id").alias("place"))
    groups = one.groupBy(F.floor(F.col("place") / 50).alias("g")).agg(F.array_sort(F.collect_list("e")).alias("events"))
    groups.select(F.to_json(F.struct("events")).alias("value")).write.text(folder)
    alarms = wire_alarms(wire_rows(t.spark, folder))
    n_ids = alarms.agg(F.count_distinct("event_id")).scalar().alias("n_ids")
    given = t.events.select(F.col("event_id").alias("_given"))
    out = alarms.join(given, alarms["event_id"] == given["_given"], "left")
    known = F.col("_given").isNotNull() & (F.col("event_id") % 5 != 0)
    stamped = F.col("event_ts") < F.lit("2026-01-01").cast("timestamp_ntz")
    return out.select(F.when(known, F.col("event_id")).alias("event_id"), "channel_id", F.when(stamped, F.col("event_ts")).alias("event_ts"),
                      "value_raw", "value_num", "value_cat", n_ids)


@query(
    "audit_latest",
    """SELECT user_login, 'look' AS action, '{"id":' || id || '}' AS details, created_at FROM b_feedback
       WHERE created_at > (SELECT max(created_at) FROM b_feedback) - INTERVAL 1 DAY""",
)
def audit_latest(t: Tables):
    """The newest audit rows of a stored table, as many as the last day has."""
    house = fresh_path(t.spark, "house")
    entries = audit_rows(t.feedback, "look", F.col("user_login"), F.col("created_at"), "id")
    entries.write.parquet(f"{house}/audit")
    newest = t.feedback.agg(F.max("created_at").alias("newest")).first()["newest"]
    n = t.feedback.where(F.col("created_at") > F.lit(newest) - F.expr("INTERVAL 1 DAY")).count()
    return dispatch_jobs.audit_list(t.spark, house, n).drop("id")


@query(
    "picket_order",
    """SELECT object_id, picket, row_number() OVER (
           PARTITION BY object_id ORDER BY no IS NULL, no, picket) AS position
       FROM (SELECT object_id, picket, TRY_CAST(nullif(regexp_extract(picket, '(\\d+)', 1), '') AS BIGINT) AS no
             FROM (SELECT DISTINCT object_id, coalesce(picket, 'без пикета') AS picket FROM o_mart_channels WHERE object_id IS NOT NULL) d) p""",
)
def picket_order(t: Tables):
    """Pickets of every object with their place in natural order, read off the sorted rows."""
    rows = hierarchy.natural_order(hierarchy.picket_profile(clean_channels(t.channels), CONFIG)).select("object_id", "picket")
    # Sorted rows are numbered in their order; the place inside an object follows from it.
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    return placed.select("object_id", "picket", F.row_number().over(Window.partitionBy("object_id").orderBy("place")).alias("position"))


@query("relational_read", "SELECT sensor_type, count(*) AS n FROM b_channels GROUP BY ALL")
def relational_read(t: Tables):
    """A stored table read into a frame with its explicit schema, only the column that is used."""
    house = fresh_path(t.spark, "house")
    clean_channels(t.channels).write.parquet(f"{house}/channels")
    stored = read_table(t.spark, f"{house}/channels", schemas.CHANNELS)
    return stored.groupBy("sensor_type").agg(F.count(F.lit(1)).alias("n"))

