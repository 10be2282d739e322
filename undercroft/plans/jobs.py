"""Batch jobs: journals to Parquet, warehouse marts, dataset build."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from undercroft import schemas
from undercroft.config import RiskConfig
from undercroft.operators import marts, profiling
from undercroft.operators.normalize import clean_channels, clean_objects, normalize_events, uploaded_alarms
from undercroft.operators.rows import first_per_key, upsert_latest
from undercroft.plans import alarm_store
from undercroft.plans.panel import build_panel
from undercroft.session import stage
from undercroft.sources import files, tables


def journals_to_parquet(
    spark: SparkSession, folder: str, target: str, years: Sequence[int] | None = None, force: bool = False
) -> list[int]:
    """Yearly journals -> events partitioned by year; years already written are skipped unless `force`.

    All years go through one read and one write. Lines that do not fit their header go to `<target>_rejects`, by file.
    Returns the years written.
    """
    found = files.journal_files(files.list_files(spark, folder), years)
    done = set() if force else tables.present_values(spark, target)
    todo = [f for f in found if f.year not in done]
    if not todo:
        return []
    _, rows, rejects = files.read_with_rejects(spark, [f.path for f in todo], "journal")
    tables.write_table(normalize_events(rows), target, ["year"])
    tables.write_table(rejects.withColumnRenamed("_file", "file"), f"{target}_rejects", ["file"])
    return sorted({f.year for f in todo})


def cluster_events(spark: SparkSession, source: str, target: str) -> None:
    """Events by year once more, with each channel's rows side by side: files cover ranges of channels, and carry a
    Bloom filter of their channels, so that a read of one channel skips the row groups of others.

    A channel that owns a large part of a year spans several files, cut by time.
    """
    rows = spark.read.parquet(source)
    placed = rows.repartitionByRange("year", "channel_id", "event_ts").sortWithinPartitions("year", "channel_id", "event_ts")
    tables.write_table(placed, target, ["year"], only_written=False, options=tables.bloom("channel_id"))


def load_dimensions(spark: SparkSession, objects_csv: str, channels_csv: str, warehouse: str) -> None:
    """Objects and channels, truncate and load. Lines that do not fit their header go to `dimension_rejects`, by file."""
    _, objects, bad_objects = files.read_with_rejects(spark, [objects_csv], "objects")
    _, channels, bad_channels = files.read_with_rejects(spark, [channels_csv], "channels")
    tables.write_table(clean_objects(objects.drop(files.POSITION)).orderBy("level", "id"), f"{warehouse}/objects")
    tables.write_table(clean_channels(channels.drop(files.POSITION)), f"{warehouse}/channels")
    rejects = bad_objects.unionByName(bad_channels).withColumnRenamed("_file", "file")
    tables.write_table(rejects, f"{warehouse}/dimension_rejects", ["file"], only_written=False)


def load_marts(spark: SparkSession, events_path: str, warehouse: str, cfg: RiskConfig) -> None:
    """Alarm and hourly marts from all years, truncate and load. Both are laid out by day for horizon reads."""
    events = spark.read.parquet(events_path)
    channels = tables.read_table(spark, f"{warehouse}/channels", schemas.CHANNELS)
    alarm_store.load_alarms(stage(marts.alarm_mart(events), "alarms"), warehouse)
    hours = marts.hourly_mart(events, channels, cfg).withColumn("day", F.col("hour_ts").cast("date"))
    tables.write_table(hours.hint("rebalance", "day"), f"{warehouse}/events_hourly", ["day"], only_written=False)


def _last_lines(rows: DataFrame) -> DataFrame:
    """The last line of each id in an upload: files by path, lines by their place."""
    return first_per_key(rows, ["id"], [F.desc(files.POSITION)]).drop(files.POSITION)


def import_files(spark: SparkSession, paths: Sequence[str], warehouse: str, kind: str | None = None) -> tuple[str, int]:
    """Uploads files of one kind into the warehouse: upsert for dimensions, insert-if-new for alarms.

    Returns the kind and the number of rows read.
    """
    headers = files.read_headers(spark, paths)
    kinds = {kind or files.detect_kind(h) for h in headers}
    if len(kinds) != 1:
        raise ValueError(f"files of several kinds: {sorted(kinds)}" if kinds else "no files to read")
    resolved = kinds.pop()
    return resolved, import_group(spark, headers, warehouse, resolved)


def import_group(
    spark: SparkSession, headers: dict[tuple[str, ...], list[str]], warehouse: str, kind: str
) -> int:
    """`import_files` for files whose headers are known; returns the number of rows read.

    Of the lines of one upload that share an id the last one counts. Lines that do not fit their header go to
    `rejected_lines`, by file and upload, beside those of earlier uploads of files of the same name.
    """
    raw, rejects = files.read_group(spark, headers, kind, trim=True)
    # Counted while the rows are read for the first time, not by a read of its own.
    seen = Observation()
    raw = stage(raw.observe(seen, F.count(F.lit(1)).alias("n")), "upload")
    n_read = seen.get["n"]
    rejects = rejects.withColumnRenamed("_file", "file").withColumn("upload", F.lit(uuid.uuid4().hex))
    tables.write_table(rejects, f"{warehouse}/rejected_lines", ["file", "upload"], mode="append")
    if kind == "objects":
        stored = tables.read_table(spark, f"{warehouse}/objects", schemas.OBJECTS)
        merged = upsert_latest(stored, _last_lines(clean_objects(raw)), ["id"], [F.desc("name")])
        tables.replace_table(merged, f"{warehouse}/objects")
    elif kind == "channels":
        objects = tables.read_table(spark, f"{warehouse}/objects", schemas.OBJECTS)
        stored = tables.read_table(spark, f"{warehouse}/channels", schemas.CHANNELS)
        merged = upsert_latest(stored, _last_lines(clean_channels(raw, objects, "lenient")), ["id"], [F.desc("name")])
        tables.replace_table(merged, f"{warehouse}/channels")
    elif kind == "journal":
        alarms = uploaded_alarms(raw).select(*marts.ALARM_COLUMNS)
        alarm_store.upload_alarms(alarms, warehouse)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return n_read


def import_bootstrap(spark: SparkSession, folder: str, warehouse: str) -> dict[str, int]:
    """Everything in a landing folder, in dependency order: objects, channels, journal. One job reads all headers."""
    routed = files.route_folder(spark, folder)
    return {
        kind: import_group(spark, routed[kind], warehouse, kind)
        for kind in ("objects", "channels", "journal")
        if kind in routed
    }


def compact_alarms(spark: SparkSession, warehouse: str, keep: int = 100) -> int:
    """Merges the mart's folders of all but the newest `keep` batches day by day; returns the days rewritten."""
    newest = max(alarm_store.stored_batches(spark, warehouse), default=-1)
    return alarm_store.compact_days(spark, warehouse, newest - keep + 1)


def build_dataset(
    spark: SparkSession, events_path: str, channels: DataFrame, weather: DataFrame | None, target: str,
    cfg: RiskConfig, years: Sequence[int] | None = None, force: bool = False,
) -> list[int]:
    """Feature panel of every missing year, partitioned by year and sorted inside files; then the build summary.

    All years are built by one plan: windows never cross a year, so years are just more groups.
    """
    wanted = tables.present_values(spark, events_path)
    wanted = {y for y in wanted if y is not None and (years is None or y in years)}
    todo = sorted(wanted if force else wanted - tables.present_values(spark, f"{target}/features"))
    if not todo:
        return []
    panel = build_panel(tables.year_range(spark, events_path, todo), channels, weather, cfg)
    panel = panel.withColumnRenamed("period", "year")
    tables.write_table(panel.sortWithinPartitions("year", "object_id", "hour_ts"), f"{target}/features", ["year"])
    update_summary(spark, target, todo)
    return todo


def update_summary(spark: SparkSession, target: str, years: Sequence[int]) -> None:
    """Rows, objects, positives and rates of the given years, merged by year into the summary table."""
    stats = profiling.build_stats(tables.year_range(spark, f"{target}/features", years), "year")
    stored = tables.read_table(spark, f"{target}/summary", stats.schema)
    tables.replace_table(upsert_latest(stored, stats, ["year"], [F.desc("n_rows")]), f"{target}/summary")
