"""Running stream jobs to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undercroft.sources.tables import write_table


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is available, appends results to a table exactly once, returns the table."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def update_log(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Update mode: each batch writes the rows that changed to its own folder."""
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: write_table(batch, f"{path}/batch={batch_id}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_of_log(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each key in an update log."""
    from pyspark.sql import functions as F

    from undercroft.operators.rows import first_per_key

    return first_per_key(spark.read.parquet(path), keys, [F.desc("batch")]).drop("batch")
