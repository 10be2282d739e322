"""New failures as they stand now: an answer goes out at once, and again when a late event changes it.

The state of a channel is its failing hours of the last `reach` hours and one quiet time more, each with the answer that
was given. An event that comes later than that cannot be placed any more; it is passed on as too late, not dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from undercroft.config import RiskConfig
from undercroft.functions.calendar import hour_number, hour_timestamp
from undercroft.functions.rules import event_flags
from undercroft.streaming.level_log import LevelLog

_STATE = T.StructType([T.StructField("hour", T.LongType()), T.StructField("fresh", T.BooleanType())])
_HOURS = "channel_id long, object_id long, hour_no long"
OUTPUT = T.StructType([
    T.StructField("channel_id", T.LongType()), T.StructField("object_id", T.LongType()), T.StructField("hour_no", T.LongType()),
    T.StructField("fresh", T.BooleanType()), T.StructField("too_late", T.BooleanType())])


def answers(hours: list[int], quiet: int) -> dict[int, bool]:
    """For rising failing hours, whether each follows `quiet` hours without one."""
    return {h: i == 0 or h - hours[i - 1] > quiet for i, h in enumerate(hours)}


class FailureHours(StatefulProcessor):
    def __init__(self, quiet: int, reach: int):
        self.quiet, self.reach = quiet, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hours = handle.getListState("hours", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(rows)
        owner = int(came["object_id"].iloc[0])
        known = {int(h): bool(fresh) for h, fresh in self.hours.get()} if self.hours.exists() else {}
        arrived = sorted({int(h) for h in came["hour_no"]})
        start = max(known) - self.reach if known else arrived[0]
        late = [h for h in arrived if h < start]
        hours = sorted({*known, *(h for h in arrived if h >= start)})
        now = answers(hours, self.quiet)
        # Hours before `start` are kept to look back at; their answers were given and cannot change any more.
        changed = [(h, now[h], False) for h in hours if h >= start and known.get(h) != now[h]]
        changed += [(h, False, True) for h in late]
        oldest = max(hours) - self.reach - self.quiet if hours else 0
        self.hours.put([(h, known.get(h, now[h]) if h < start else now[h]) for h in hours if h >= oldest])
        if changed:
            yield pd.DataFrame([(key[0], owner, *c) for c in changed], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task sends each failing hour of a channel once a batch of rows."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield from table.group_by(table.column_names).aggregate([]).select(table.column_names).to_batches()


def failure_corrections(events: DataFrame, channels: DataFrame, cfg: RiskConfig, reach_hours: int) -> DataFrame:
    """(channel_id, object_id, hour_no, fresh, too_late): every answer that is new or has changed, in update mode.

    `fresh` tells whether the channel fails in that hour and did not during the day before, by all events so far.
    """
    dims = channels.filter(F.col("object_id").isNotNull()).select(F.col("id").alias("channel_id"), "sensor_type", "object_id")
    failing = events.join(dims, "channel_id").filter(event_flags(cfg)["ev_failure"]).select(
        "channel_id", "object_id", hour_number(F.col("event_ts")).cast("long").alias("hour_no"))
    hours = failing.mapInArrow(_distinct, _HOURS)
    return hours.groupBy("channel_id").transformWithStateInPandas(
        FailureHours(cfg.history_hours, reach_hours), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def _newest(rows: DataFrame) -> DataFrame:
    # A late arrival never replaces an answer.
    keys = ("channel_id", "hour_no", "too_late")
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "turn").alias("s"))
    return last.select(*keys, "s.*").select(*rows.columns)


def answer_log(spark: SparkSession, path: str) -> LevelLog:
    return LevelLog(spark, path, _newest)


def run_corrections(answers_stream: DataFrame, path: str, checkpoint: str) -> None:
    """Adds all answers of what has arrived to the log at `path`, where the last one of a channel and hour counts."""
    def write(batch: DataFrame, batch_id: int) -> None:
        log = answer_log(batch.sparkSession, path)
        log.add(batch.withColumn("turn", F.lit(batch_id).cast("long")), checkpoint, batch_id)

    query = (answers_stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def current_failures(spark: SparkSession, path: str) -> DataFrame:
    """(channel_id, object_id, hour_ts) of the new failures as they stand."""
    return answer_log(spark, path).merged().filter("fresh and not too_late").select(
        "channel_id", "object_id", hour_timestamp(F.col("hour_no")).alias("hour_ts"))


def too_late(spark: SparkSession, path: str) -> DataFrame:
    """Failing hours that came after they could be placed."""
    return answer_log(spark, path).rows().filter("too_late").select(
        "channel_id", "object_id", hour_timestamp(F.col("hour_no")).alias("hour_ts")).distinct()
