"""New-failure detector as a stream: a channel fails now and did not fail during the day before.

Failing events are first counted per channel and hour in the JVM; only finished failing hours, which the watermark
releases in time order, reach the Python state code. The state of a channel is a single number: its last failing hour.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from undercroft.config import RiskConfig
from undercroft.functions.calendar import hour_number, hour_timestamp
from undercroft.functions.rules import event_flags
from undercroft.streaming.sources import TIME

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HOUR = T.StructType([T.StructField("hour", T.LongType())])
OUTPUT = T.StructType([
    T.StructField("channel_id", T.LongType()), T.StructField("object_id", T.LongType()),
    T.StructField("hour_no", T.LongType()),
])


class LastFailure(StatefulProcessor):
    """Keeps the last failing hour of a channel and emits hours that follow a quiet day."""

    def __init__(self, quiet_hours: int):
        self.quiet_hours = quiet_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _HOUR)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hours = pd.concat(rows).sort_values("hour_no")[["object_id", "hour_no"]]
        before = hours["hour_no"].shift()
        if self.last.exists():
            before = before.fillna(self.last.get()[0])
        new = hours[before.isna() | (hours["hour_no"] - before > self.quiet_hours)]
        self.last.update((int(hours["hour_no"].iloc[-1]),))
        if len(new):
            yield new.assign(channel_id=key[0])[OUTPUT.names]

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keeps stream state in RocksDB, which this operator needs."""
    spark.conf.set(PROVIDER_KEY, PROVIDER)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """RocksDB for the queries started inside."""
    before = spark.conf.get(PROVIDER_KEY, None)
    use_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)


def new_failure_stream(events: DataFrame, channels: DataFrame, cfg: RiskConfig, lateness: str) -> DataFrame:
    """(channel_id, object_id, hour_ts) of every new failure, once its hour is behind the watermark.

    The filter sits above the hourly count, so the watermark follows all events and not just failing ones.
    """
    dims = channels.filter(F.col("object_id").isNotNull()).select(
        F.col("id").alias("channel_id"), "sensor_type", "object_id"
    )
    hours = (
        events.withWatermark(TIME, lateness)
        .join(dims, "channel_id")
        .groupBy(F.window(TIME, "1 hour").alias("w"), "channel_id", "object_id")
        .agg(F.count_if(event_flags(cfg)["ev_failure"]).alias("n_failure"))
        .filter(F.col("n_failure") > 0)
        .select("channel_id", "object_id", hour_number(F.col("w.start").cast("timestamp_ntz")).alias("hour_no"))
    )
    found = hours.groupBy("channel_id").transformWithStateInPandas(
        LastFailure(cfg.history_hours), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
    return found.select("channel_id", "object_id", hour_timestamp(F.col("hour_no")).alias("hour_ts"))
