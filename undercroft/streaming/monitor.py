"""Progress of streams as a table: one row a batch, with its latency against the goal.

The listener only takes down what Spark tells it; a thread of its own writes what has come together, so a slow disk does
not hold up the listener bus.
"""

from __future__ import annotations

import datetime as dt
import queue
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from undercroft.streaming.level_log import LevelLog

PROGRESS = ("query_id string, run_id string, name string, batch_id long, started_at timestamp_ntz, input_rows long, "
            "seconds double, within_slo boolean")
_KEYS = ("query_id", "batch_id")


def _last_of_batch(rows: DataFrame) -> DataFrame:
    """A batch that was run again counts by its last run."""
    values = [c for c in rows.columns if c not in _KEYS]
    last = rows.groupBy(*_KEYS).agg(F.max_by(F.struct(*values), "started_at").alias("s"))
    return last.select(*_KEYS, "s.*").select(*rows.columns)


def progress_log(spark: SparkSession, path: str) -> LevelLog:
    return LevelLog(spark, path, lambda rows: _last_of_batch(rows).coalesce(1))


class ProgressListener(StreamingQueryListener):
    """Writes the progress of every query of the session to a table; `close` after the queries have ended.

    Batches that found no new rows are reported by Spark without a new number and are left out.
    """

    def __init__(self, spark: SparkSession, path: str, slo_seconds: float):
        self.spark, self.path, self.slo_seconds = spark, path, slo_seconds
        self.running: set[str] = set()
        self.ended = threading.Condition()
        self.rows: queue.Queue = queue.Queue()
        self.writer = threading.Thread(target=self._write, daemon=True)
        self.writer.start()
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        with self.ended:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            seconds = p.batchDuration / 1000.0
            started = dt.datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).replace(tzinfo=None)
            self.rows.put((str(p.id), str(p.runId), p.name, p.batchId, started, p.numInputRows, seconds, seconds < self.slo_seconds))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.running.discard(str(event.runId))
            self.ended.notify_all()

    def _write(self) -> None:
        log, last = progress_log(self.spark, self.path), False
        while not last:
            batch = [self.rows.get()]
            while not self.rows.empty():
                batch.append(self.rows.get())
            last = batch[-1] is None
            batch = [row for row in batch if row is not None]
            if batch:
                turn = log.manifest().sources.get("listener", -1) + 1
                log.add(self.spark.createDataFrame(batch, PROGRESS).coalesce(1), "listener", turn)

    def close(self, timeout: float = 60) -> None:
        """Waits for the queries' last words, at most `timeout` seconds, and writes what is left."""
        with self.ended:
            self.ended.wait_for(lambda: not self.running, timeout)
        self.spark.streams.removeListener(self)
        self.rows.put(None)
        self.writer.join(timeout)


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    return progress_log(spark, path).merged()
