"""Row-level helpers shared by the operators: one row per key, upserts, running totals, ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from undercroft.session import stage

#: Rows that one task adds up, about.
SLICE_ROWS = 500_000


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key.

    Spark limits each group before the shuffle, so a hot key sends only `n` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def insert_new(existing: DataFrame, batch: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows of `batch` to append: the first of each key, if the key is not in `existing` yet."""
    return first_per_key(batch, [key], order).join(existing.select(key), key, "left_anti")


def upsert_latest(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The table after an upsert: a batch row replaces the stored one, the first by `order` wins inside the batch."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return first_per_key(both, keys, [F.desc("_new"), *order]).drop("_new")


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], tag: str = "running"
) -> DataFrame:
    """Adds inclusive running totals along `order` inside `keys`, without a window that one task must hold.

    Rows are range-partitioned by (keys, order) into slices; slice totals become offsets; the running sum itself is
    local to a slice. A key that owns most rows simply spans many slices, of SLICE_ROWS rows about. `order` must be
    unique inside a key. The rows are written and counted before they are sliced, and once more as slices, because range
    bounds are sampled: a recomputed branch could slice differently.
    """
    names = list(sums)
    seen = Observation()
    rows = df.withColumns({f"_v_{n}": c for n, c in sums.items()}).observe(seen, F.count(F.lit(1)).alias("n"))
    sliced = stage(rows, tag)
    slices = max(1, -(-seen.get["n"] // SLICE_ROWS))
    sliced = sliced.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    sliced = stage(sliced, tag)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
        .select(*keys, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(local) for n in names})
        .drop("_slice", *[f"_v_{n}" for n in names], *[f"_o_{n}" for n in names])
    )


def assign_running_ids(batch: DataFrame, existing: DataFrame, id_col: str, order: Sequence[Column]) -> DataFrame:
    """Fills missing ids with the stored maximum plus the row's position in the batch (all rows are counted)."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    numbered = running_totals(
        batch.withColumn("_all", F.lit(1)), ["_all"], order, {"_position": F.lit(1).cast("bigint")}, "ids"
    )
    return numbered.withColumn(id_col, F.coalesce(F.col(id_col), top + F.col("_position"))).drop("_all", "_position")


def hashed_id(*parts: Column) -> Column:
    """A replay-safe positive id made from a row's own content."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def reproducible_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """`n` rows without replacement, the same ones on every run: those with the smallest keyed digests."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn("_digest", digest).orderBy("_digest", *keys).limit(n).drop("_digest")
