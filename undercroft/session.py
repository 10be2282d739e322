"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "undercroft", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    Shuffle partitions are left to the cluster (AQE coalesces them); only size-checked behaviour is set here.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Spark broadcasts a side only when its measured size is below this.
        "spark.sql.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    conf.update(extra)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in `spark.checkpoint.dir`, else one beside the warehouse.

    The second case is for local sessions that name none, as in tests; a cluster has to name one.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/undercroft-staged"


_made: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, remembered until `drop_staged`."""
    _made.append(f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_staged(spark: SparkSession) -> None:
    """Removes the tables that this process has staged, once nothing reads them any more: at the end of a job."""
    while _made:
        target = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written table.

    Later branches see exactly the same rows, and a lost executor re-reads files instead of recomputing the plan.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
