"""Parquet tables: partitioned writes, skipping what is there, replacing a table in one step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undercroft.sources import snapshots


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table as it is now, or an empty one of the given schema when nothing was written yet.

    The frame stays with the version that is current at the call, also while the table is replaced.
    """
    root = snapshots.current_root(spark, path)
    try:
        return spark.read.parquet(root) if schema is None else spark.read.schema(schema).parquet(root)
    except AnalysisException as error:
        if schema is None or "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", only_written: bool = True,
    options: dict[str, str] | None = None,
) -> None:
    """Writes a table. With partitions an overwrite replaces the written ones only, or, with `only_written` off, all."""
    kind = "dynamic" if only_written and partition_by else "static"
    writer = df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", kind).options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def bloom(*columns: str) -> dict[str, str]:
    """Write options that add a Bloom filter of each column to every row group."""
    return {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replaces a table by rows that may be computed from it, in one step: readers see the old rows or the new ones.

    Fails with `snapshots.ReplacedByAnother`, and changes nothing, if the table was replaced in the meantime.
    """
    snapshots.publish(df.sparkSession, path, lambda draft: write_table(df, draft, partition_by, only_written=False))


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the first partition column, read from the names of the folders; no file is opened."""
    fs, target = snapshots.folder(spark, path)
    if not fs.exists(target):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(target) if status.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def present_values(spark: SparkSession, path: str, column: str = "year") -> set[int | None]:
    """Numbers of the partitions already written; None stands for the folder of rows without a value."""
    return {int(v) if v.lstrip("-").isdigit() else None for v in partition_values(spark, path, column)}


def year_range(spark: SparkSession, path: str, years: Sequence[int]) -> DataFrame:
    """Several years of a table in one scan; other partitions are pruned."""
    return spark.read.parquet(path).where(F.col("year").isin(*years))
