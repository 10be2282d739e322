"""The stored alarm mart and its key table.

  events_alarm/day=…/batch=…         every accepted alarm once; batch -1 holds bulk loads and compacted days
  events_alarm_ids/bucket=…/batch=…  the ids alone, so that a batch looks up its own ids and not the mart
  events_alarm_uploads/<batch>       one empty file for each upload whose rows and ids are both written
Both tables are written by day (or bucket) and batch, so a batch that runs again overwrites what it wrote before.
Batches of streams have numbers from 0, uploads have -2, -3, …
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undercroft.config import RiskConfig
from undercroft.operators.marts import ALARM_COLUMNS
from undercroft.operators.rows import first_per_key
from undercroft.schemas import ALARMS
from undercroft.session import stage
from undercroft.sources import snapshots
from undercroft.sources.tables import partition_values, read_table, write_table

MART, KEYS, UPLOADS = "events_alarm", "events_alarm_ids", "events_alarm_uploads"
BULK = -1
MART_SCHEMA = T.StructType([*ALARMS.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
KEY_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("batch", T.LongType())])
# Given ids are small and rise with time, so neighbours share a bucket; ids made from content spread over these many.
_RANGE, _GIVEN, _HASHED = 1_000_000, 1 << 40, 1024


def key_bucket(event_id: Column) -> Column:
    return F.when(event_id.between(0, _GIVEN), F.floor(event_id / _RANGE)).otherwise(
        -1 - F.pmod(F.xxhash64(event_id), F.lit(_HASHED))).cast("long")


def stored_alarms(spark: SparkSession, warehouse: str) -> DataFrame:
    return read_table(spark, f"{warehouse}/{MART}", MART_SCHEMA)


def _write(alarms: DataFrame, warehouse: str, batch: int, mode: str, only_written: bool) -> None:
    placed = alarms.select(*ALARM_COLUMNS, F.col("event_ts").cast("date").alias("day"), F.lit(batch).cast("long").alias("batch"))
    # Whole days side by side; a large day is split over several tasks and files.
    placed = placed.hint("rebalance", "day").sortWithinPartitions("day", "event_ts")
    write_table(placed, f"{warehouse}/{MART}", ["day", "batch"], mode, only_written)
    _write_keys(alarms, warehouse, batch, mode, only_written)


def _write_keys(alarms: DataFrame, warehouse: str, batch: int, mode: str, only_written: bool) -> None:
    keys = alarms.select("event_id", key_bucket(F.col("event_id")).alias("bucket"), F.lit(batch).cast("long").alias("batch"))
    write_table(keys.hint("rebalance", "bucket"), f"{warehouse}/{KEYS}", ["bucket", "batch"], mode, only_written)


def load_alarms(alarms: DataFrame, warehouse: str) -> None:
    """Truncate and load: days and buckets that have no rows any more go as well."""
    _write(alarms, warehouse, BULK, "overwrite", only_written=False)


def new_alarms(batch: DataFrame, warehouse: str, batch_id: int) -> DataFrame:
    """Rows of a batch that no other batch has stored: the first of each id by time and channel.

    A batch that runs again replaces its folders, so its own ids do not count as stored, unless its rows have been
    merged into the days' common folders since. Only the key buckets of the batch's own ids are read, as a literal
    filter prunes the others.
    """
    spark = batch.sparkSession
    first = first_per_key(batch, ["event_id"], [F.asc("event_ts"), F.asc("channel_id")])
    bucket = key_bucket(F.col("event_id"))
    wanted = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most the batch's rows
    own = batch_id if batch_id in stored_batches(spark, warehouse) else None
    return first.join(known_keys(spark, warehouse, wanted, own), "event_id", "left_anti")


def stored_batches(spark: SparkSession, warehouse: str, table: str = MART) -> set[int]:
    """Batches that have folders of their own, by the folders' names."""
    fs, pattern = snapshots.folder(spark, f"{warehouse}/{table}/*/batch=*")
    return {int(s.getPath().getName().split("=", 1)[1]) for s in fs.globStatus(pattern) or []}


def known_keys(spark: SparkSession, warehouse: str, buckets: list[int], batch_id: int | None) -> DataFrame:
    """Ids stored in some buckets by other batches."""
    keys = read_table(spark, f"{warehouse}/{KEYS}", KEY_SCHEMA).where(F.col("bucket").isin(buckets))
    return (keys if batch_id is None else keys.where(F.col("batch") != batch_id)).select("event_id")


def add_alarms(alarms: DataFrame, warehouse: str, batch_id: int) -> None:
    """Stores the rows of one batch; the same batch again replaces them."""
    _write(alarms, warehouse, batch_id, "overwrite", only_written=True)


def upload_alarms(alarms: DataFrame, warehouse: str) -> int:
    """Stores the rows of an upload that are not stored yet, as a batch of its own; returns the batch.

    An upload that was cut short after its rows and before its ids is completed first: its ids are written again from
    its rows, so that they are known to this one. One upload runs at a time.
    """
    spark = alarms.sparkSession
    heal_uploads(spark, warehouse)
    taken = [*_finished(spark, warehouse), *stored_batches(spark, warehouse), *stored_batches(spark, warehouse, KEYS)]
    batch_id = min([BULK, *taken]) - 1
    fresh = stage(new_alarms(alarms, warehouse, batch_id), "upload")
    add_alarms(fresh, warehouse, batch_id)
    _finish(spark, warehouse, batch_id)
    return batch_id


def _finished(spark: SparkSession, warehouse: str) -> set[int]:
    return {int(n) for n in snapshots.child_names(spark, f"{warehouse}/{UPLOADS}") if n.lstrip("-").isdigit()}


def _finish(spark: SparkSession, warehouse: str, batch_id: int) -> None:
    fs, done = snapshots.folder(spark, f"{warehouse}/{UPLOADS}/{batch_id}")
    fs.create(done, True).close()


def heal_uploads(spark: SparkSession, warehouse: str) -> list[int]:
    """Writes the ids of uploads that have rows but were not finished; returns their batches."""
    open_batches = sorted(b for b in stored_batches(spark, warehouse) - _finished(spark, warehouse) if b < BULK)
    for batch_id in open_batches:
        _write_keys(stored_alarms(spark, warehouse).where(F.col("batch") == batch_id), warehouse, batch_id, "overwrite", True)
        _finish(spark, warehouse, batch_id)
    return open_batches


def recent_alarms(spark: SparkSession, warehouse: str, cfg: RiskConfig) -> DataFrame:
    """The part of the mart that can lie inside the horizon: its newest day folders, known by their names."""
    days = [d for d in partition_values(spark, f"{warehouse}/{MART}", "day") if d[:1].isdigit()]
    table = stored_alarms(spark, warehouse)
    if not days:
        return table
    back = -(-cfg.horizon_hours // 24)
    return table.where(F.col("day") >= F.date_sub(F.lit(days[-1]).cast("date"), back))


def newest_alarms(spark: SparkSession, warehouse: str, n: int, channel_id: int | None = None) -> DataFrame:
    """The `n` newest alarms (of a channel, if given), without a look at older days.

    Day folders are known by their names. They are taken from the newest on, twice as many each time, until they hold
    `n` such rows, which the files' own counts tell where no channel is asked for.
    """
    days = [d for d in partition_values(spark, f"{warehouse}/{MART}", "day") if d[:1].isdigit()]
    table = stored_alarms(spark, warehouse)
    if channel_id is not None:
        table = table.where(F.col("channel_id") == channel_id)
    taken = 1
    while days:
        rows = table.where(F.col("day") >= F.lit(days[-min(taken, len(days))]).cast("date"))
        if taken >= len(days) or rows.count() >= n:
            table = rows
            break
        taken *= 2
    return table.select(*ALARM_COLUMNS).orderBy(F.desc("event_ts"), F.desc("event_id")).limit(n)


def compact_days(spark: SparkSession, warehouse: str, below: int) -> int:
    """Merges what uploads and batches before `below` wrote into one folder a day; returns the number of days rewritten.

    Rows are read once per id, so a run cut short before the old folders went is healed by the next one. No batch and
    no upload may run at the same time.
    """
    path = f"{warehouse}/{MART}"
    heal_uploads(spark, warehouse)
    table = stored_alarms(spark, warehouse).where(F.col("batch") < below)
    crowded = [r["day"] for r in table.where(F.col("batch") != BULK).select("day").distinct().collect()]
    if not crowded:
        return 0
    rows = table.where(F.col("day").isin(crowded))
    merged = first_per_key(rows, ["event_id"], [F.asc("event_ts"), F.asc("channel_id")])
    merged = merged.withColumn("batch", F.lit(BULK).cast("long")).hint("rebalance", "day")
    write_table(stage(merged, "compact").sortWithinPartitions("day", "event_ts"), path, ["day", "batch"])
    _drop_batches(spark, path, [f"day={d}" for d in crowded], below)
    _compact_keys(spark, warehouse, below)
    return len(crowded)


def _compact_keys(spark: SparkSession, warehouse: str, below: int) -> None:
    path = f"{warehouse}/{KEYS}"
    keys = read_table(spark, path, KEY_SCHEMA).where(F.col("batch") < below)
    buckets = [r["bucket"] for r in keys.where(F.col("batch") != BULK).select("bucket").distinct().collect()]
    merged = keys.where(F.col("bucket").isin(buckets)).select("event_id", "bucket").distinct()
    merged = stage(merged.withColumn("batch", F.lit(BULK).cast("long")), "compact-ids")
    write_table(merged.hint("rebalance", "bucket"), path, ["bucket", "batch"])
    _drop_batches(spark, path, [f"bucket={b}" for b in buckets], below)


def _drop_batches(spark: SparkSession, path: str, folders: list[str], below: int) -> None:
    for folder in folders:
        for batch in partition_values(spark, f"{path}/{folder}", "batch"):
            if int(batch) != BULK and int(batch) < below:
                snapshots.delete(spark, f"{path}/{folder}/batch={batch}")
