"""Online ingest: alarms into the mart, touched objects rescored, one log of batches.

Tables under the warehouse folder:
  events_alarm, events_alarm_ids  every accepted alarm once, and its key (plans/alarm_store.py)
  rejects/batch=…           alarms of unknown channels
  rule_state/               open rule predictions of each rescored object, a log that merges old batches
  batches/batch=…           sizes and latency
An alarm is stored however late it comes; a repeat is known by its id, from this batch or any before. A batch that is
run again after a failure overwrites its own folders and adds nothing twice to the mart.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from undercroft.config import RiskConfig
from undercroft.operators.alarm_risk import score_alarms
from undercroft.operators.marts import ALARM_COLUMNS
from undercroft.plans import alarm_store
from undercroft.sources.tables import write_table
from undercroft.streaming.level_log import LevelLog

SLO_SECONDS = 300


@dataclass
class AlarmIngest:
    """Handles one micro-batch of alarms (the columns of ALARMS)."""

    channels: DataFrame
    warehouse: str
    cfg: RiskConfig
    #: Tells apart streams whose batches have the same numbers; `start_ingest` takes the checkpoint.
    source: str = ""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        spark = batch.sparkSession
        dims = self.channels.select(F.col("id").alias("channel_id"), "object_id", F.lit(True).alias("_known"))
        batch = batch.select(*ALARM_COLUMNS).join(dims, "channel_id", "left")
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            known = batch.filter(F.col("_known"))
            sizes = batch.agg(
                F.count(F.lit(1)).alias("received"), F.count_if(F.col("_known").isNull()).alias("rejected")
            )
            rejects = batch.filter(F.col("_known").isNull()).select(*ALARM_COLUMNS)
            write_table(rejects, self._part("rejects", batch_id))
            fresh = alarm_store.new_alarms(known.select(*ALARM_COLUMNS), self.warehouse, batch_id)
            alarm_store.add_alarms(fresh, self.warehouse, batch_id)
            # Objects of all accepted rows, not only of the newly stored ones: a rerun must rescore them as well.
            state = rule_state(spark, self.warehouse)
            if not state.holds(self.source, batch_id):
                touched = known.filter(F.col("object_id").isNotNull()).select("object_id").distinct()
                recent = alarm_store.recent_alarms(spark, self.warehouse, self.cfg)
                created = score_alarms(recent, self.channels, self.cfg, touched)
                state.add(object_predictions(touched, created, state.manifest().number + 1), self.source, batch_id)
            spent = time.monotonic() - started
            write_table(
                sizes.withColumns({"latency_seconds": F.lit(spent), "within_slo": F.lit(spent < SLO_SECONDS)}),
                self._part("batches", batch_id),
            )
        finally:
            batch.unpersist()

    def _part(self, table: str, batch_id: int) -> str:
        return f"{self.warehouse}/{table}/batch={batch_id}"


def object_predictions(touched: DataFrame, created: DataFrame, turn: int) -> DataFrame:
    """(object_id, turn, predictions) of each rescored object, predictions being those created for it, at most one a
    risk. An object without risks has an empty list, which ends what it had before."""
    columns = [c for c in created.columns if c != "object_id"]
    lists = created.groupBy("object_id").agg(F.collect_list(F.struct(*columns)).alias("predictions"))
    empty = F.array().cast(lists.schema["predictions"].dataType)
    return touched.join(lists, "object_id", "left").select(
        "object_id", F.lit(turn).cast("long").alias("turn"), F.coalesce("predictions", empty).alias("predictions"))


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("object_id").agg(F.max("turn").alias("newest"), F.max_by("predictions", "turn").alias("predictions")).select(
        "object_id", F.col("newest").alias("turn"), "predictions")


def rule_state(spark: SparkSession, warehouse: str) -> LevelLog:
    return LevelLog(spark, f"{warehouse}/rule_state", _newest)


def start_ingest(alarms: DataFrame, ingest: AlarmIngest, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    named = replace(ingest, source=ingest.source or checkpoint)
    writer = alarms.select(*ALARM_COLUMNS).writeStream.foreachBatch(named).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_rule_predictions(spark: SparkSession, warehouse: str) -> DataFrame:
    """Open rule predictions now: for each object those of the last batch that rescored it."""
    state = rule_state(spark, warehouse).merged()
    return state.select("object_id", F.inline("predictions"))


def progress_rows(query: StreamingQuery) -> DataFrame:
    """Recent progress of a query with its latency goal: a short driver-side list."""
    spark = SparkSession.getActiveSession()
    rows = [
        (p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000.0)
        for p in query.recentProgress
    ]
    out = spark.createDataFrame(rows, "batch_id long, input_rows long, seconds double")
    return out.withColumn("within_slo", F.col("seconds") < SLO_SECONDS)
