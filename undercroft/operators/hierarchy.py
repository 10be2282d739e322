"""The object tree: ancestors, children, pickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.config import RiskConfig
from undercroft.functions.pickets import picket_number
from undercroft.operators.rows import first_per_key
from undercroft.session import stage


def ancestors(objects: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(object_id, distance, ancestor_id, kind, name, level) for every object of `start` (all by default).

    Paths double: a round knows the ancestors up to 2**k levels away, and a pointer from every object to the one exactly
    so far above it; following the pointer from each known ancestor gives the next 2**k levels. So there are as many
    rounds as the logarithm of the depth. A climb stops at a missing parent, or at a parent it has already met (a
    cycle): what comes after that has all been met nearer by.
    """
    ids = objects.select(F.col("id").alias("object_id")) if start is None else start.select("object_id")
    known = objects.select("id").distinct()
    # Parent id 0 and NULL both mean "no parent".
    pointers = objects.filter(F.coalesce("parent_id", F.lit(0)) != 0).select("id", F.col("parent_id").alias("up"))
    pointers = stage(pointers.join(known.withColumnRenamed("id", "up"), "up", "left_semi").select("id", "up"), "pointers")
    found = pointers.join(ids.distinct(), pointers["id"] == ids["object_id"], "left_semi").select(
        F.col("id").alias("object_id"), F.lit(1).alias("distance"), F.col("up").alias("ancestor_id"))
    found, reach = stage(found, "ancestors"), 1
    size = found.count()
    while size and not pointers.isEmpty():
        above = pointers.select(F.col("id").alias("ancestor_id"), "up")
        further = found.join(above, "ancestor_id").select(
            "object_id", (F.col("distance") + reach).alias("distance"), F.col("up").alias("ancestor_id"))
        # An ancestor met again lies on a cycle; its first meeting counts.
        found = stage(found.unionByName(further).groupBy("object_id", "ancestor_id").agg(
            F.min("distance").alias("distance")).select("object_id", "distance", "ancestor_id"), "ancestors")
        before, size = size, found.count()
        if size == before:
            break
        via = pointers.select(F.col("id").alias("via"), F.col("up").alias("further"))
        twice = pointers.withColumnRenamed("up", "via").join(via, "via")
        pointers, reach = stage(twice.select("id", F.col("further").alias("up")), "pointers"), 2 * reach
    nodes = objects.select(F.col("id").alias("ancestor_id"), "kind", "name", "level")
    return found.join(nodes, "ancestor_id").select("object_id", "distance", "ancestor_id", "kind", "name", "level")


def root_first(chain: DataFrame) -> DataFrame:
    """Adds `position`, 1 for the root, from the distance to the object."""
    depth = chain.groupBy("object_id").agg(F.max("distance").alias("_depth"))
    return chain.join(depth, "object_id").withColumn("position", F.col("_depth") - F.col("distance") + 1).drop("_depth")


def children(objects: DataFrame) -> DataFrame:
    """(object_id, child_id, kind, name, level): rows, not lists, so a crowded parent stays distributed."""
    return objects.filter(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("object_id"), F.col("id").alias("child_id"), "kind", "name", "level"
    )


def picket_profile(channels: DataFrame, cfg: RiskConfig, types_shown: int = 8) -> DataFrame:
    """Per (object, picket): channels, first sensor types in order, and which families are present.

    Sensor types are made distinct and cut to the ones shown before they are collected.
    """
    by_type = (
        channels.filter(F.col("object_id").isNotNull())
        .groupBy("object_id", F.coalesce(F.nullif("picket", F.lit("")), F.lit(cfg.no_picket)).alias("picket"), "sensor_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = ["object_id", "picket"]
    kind = F.col("sensor_type")
    facts = by_type.groupBy(*keys).agg(
        F.sum("n").alias("n_channels"),
        F.bool_or(kind.isin(*cfg.card_fire_types)).alias("has_fire"),
        F.bool_or(kind.isin(*cfg.card_flood_types)).alias("has_flood"),
        F.bool_or(kind.isin(*cfg.card_guard_types)).alias("has_guard"),
    )
    shown = first_per_key(by_type, keys, [F.asc("sensor_type")], types_shown)
    lists = shown.groupBy(*keys).agg(F.array_sort(F.collect_list("sensor_type")).alias("sensor_types"))
    return facts.join(lists, keys).withColumn("picket_no", picket_number(F.col("picket")))


def natural_order(rows: DataFrame) -> DataFrame:
    """By object, then by the first number of the picket, text-only pickets last."""
    number = picket_number(F.col("picket"))
    return rows.orderBy("object_id", number.isNull(), number, "picket")


def picket_extent(pickets: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Per object: lowest and highest picket number, numbered pickets, channels outside pickets."""
    named = F.col("picket") != cfg.no_picket
    number = F.col("picket_no")
    return pickets.groupBy("object_id").agg(
        F.min(F.when(named, number)).alias("picket_min"),
        F.max(F.when(named, number)).alias("picket_max"),
        F.count_if(named).alias("n_pickets"),
        F.coalesce(F.sum(F.when(~named, F.col("n_channels"))), F.lit(0)).alias("n_outside"),
    )


def active_risks(events: DataFrame) -> DataFrame:
    """Risks seen per (object, picket), as distinct rows; events without picket or risk do not count."""
    return (
        events.filter(F.col("risk").isNotNull() & (F.coalesce("picket", F.lit("")) != ""))
        .select("object_id", "picket", "risk")
        .distinct()
    )


def picket_priority(pickets: DataFrame, risks: DataFrame, cfg: RiskConfig, shown: int = 36) -> DataFrame:
    """Pickets to draw: every one with an active risk, topped up with the lowest numbers to `shown` per object."""
    hot = risks.select("object_id", "picket").distinct().withColumn("_hot", F.lit(True))
    marked = (
        pickets.filter(F.col("picket") != cfg.no_picket)
        .join(hot, ["object_id", "picket"], "left")
        .withColumn("is_hot", F.coalesce("_hot", F.lit(False)))
        .drop("_hot")
    )
    order = [F.desc("is_hot"), F.coalesce("picket_no", F.lit(0)), F.asc("picket")]
    best = first_per_key(marked, ["object_id"], order, shown)
    return marked.filter("is_hot").unionByName(best.filter(~F.col("is_hot")))
