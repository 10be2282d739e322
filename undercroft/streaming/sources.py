"""Stream sources and the columns the stream jobs work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undercroft.functions import values
from undercroft.operators.rows import hashed_id
from undercroft.schemas import WIRE_BATCH

# Event time as an instant: watermarks do not take zone-less timestamps. The session zone must be UTC.
TIME = "event_time"


def with_event_time(df: DataFrame, column: str = "event_ts") -> DataFrame:
    return df.withColumn(TIME, F.col(column).cast("timestamp"))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """Parquet files appearing under a path, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _wire(lines: DataFrame) -> DataFrame:
    """Lines `{"events": [...]}` as one row an event, with `_place`: a number that stands for the event's file, line and
    place in the line. The same line twice in a file is the same batch sent twice."""
    parsed = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.from_json("value", WIRE_BATCH).alias("_batch"))
    events = parsed.select("_file", "value", F.posexplode("_batch.events").alias("_at", "_event"))
    return events.select("_event.*", hashed_id(F.col("_file"), F.col("value"), F.col("_at")).alias("_place"))


def wire_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """JSON batches `{"events": [...]}`, one per line, as rows."""
    return _wire(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder))


def wire_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON batches that lie in a folder, as rows."""
    return _wire(spark.read.text(folder))


def wire_alarms(rows: DataFrame) -> DataFrame:
    """Wire rows -> alarms: the alarm flag defaults to true, a missing time is now, and a missing id comes from the
    content, or from the event's place where the time is missing as well, so that a replay gets the same ids."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    value, time = F.col("value"), F.col("event_ts")
    made = F.when(time.isNotNull(), hashed_id(F.col("channel_id"), time, value)).otherwise(F.col("_place"))
    typed = (
        rows.filter(F.coalesce("alarm", F.lit(True)))
        .withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit(0)), made))
        .withColumn("event_ts", F.coalesce(time, now))
        .withColumn("value_num", values.to_number(value, "lenient"))
    )
    return typed.select(
        "event_id", "channel_id", "event_ts", value.alias("value_raw"), "value_num",
        values.to_category(value, F.col("value_num"), "lenient").alias("value_cat"),
    )
