"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.session import stage

#: Largest number of label passes before a component run is given up as a fault.
MAX_ROUNDS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def components(edges: DataFrame, a: str, b: str, tag: str) -> DataFrame:
    """Connected components of an undirected edge table: (node, component), component being the smallest node.

    Alternating large-star and small-star steps: every step points nodes at the smallest node they can see, so the
    number of steps grows with the logarithm of the longest chain. Each step is written to the shared folder, which
    cuts lineage. Only nodes that stand in an edge are returned; self-loops and nulls are ignored.

    A node with very many neighbours is no hot spot: the smallest neighbour comes from a map-side combined minimum and
    is joined back, never collected into a list.
    """
    current = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    current = current.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = stage(current, f"{tag}-edges")
    before = None
    for _ in range(MAX_ROUNDS):
        large = _star(current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        small = _star(large, larger=False)
        current = stage(small.distinct(), f"{tag}-star")
        # Settled when every edge points at a root and roots stand on the right side only.
        after = tuple(current.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first())
        if after == before:
            return (
                current.select(F.col("u").alias("node"), F.col("v").alias("component"))
                .unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("component")))
                .distinct()
            )
        before = after
    raise RuntimeError("components did not settle")


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Points the larger neighbours (or the smaller ones and the node itself) of u at the smallest node around u."""
    if larger:
        lowest = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        return pairs.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lowest.select("u", F.col("m").alias("v")))
