"""Centroid clustering over a vector-approximation file.

Every vector is kept twice: as few-bit cells, one per dimension, and in full. An assignment looks the cells up in tables
that give an interval of the distance to each centroid; the full vector is taken only where intervals overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from undercroft.session import stage

INDEX = "vec_id long, cells binary, v binary"
ASSIGNED = "vec_id long, cluster int, distance long"
RESULT = f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string"
#: Components beyond this bound count as the bound, so that squared distances stay inside 64 bits.
BOUND = 2 ** 27
LARGEST = 2 ** 63 - 1
#: Exact distances that a task computes at a time.
PAIRS = 16_384


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 40
    rounds: int = 5
    width: int = 64
    scale: int = 256
    #: What the keys of the first centroids are hashed with.
    seed: int = 2
    #: Bits of a cell, at most 8.
    bits: int = 6
    #: Share of a dimension's values below the first and above the last inner cell.
    tail: float = 0.01


@dataclass(frozen=True)
class Grid:
    """Cells of each dimension: cell j holds the integers in low[d, j] .. high[d, j]."""

    low: np.ndarray
    high: np.ndarray

    def cells(self, v: np.ndarray) -> np.ndarray:
        out = np.empty(v.shape, np.uint8)
        for d in range(v.shape[1]):
            out[:, d] = np.searchsorted(self.high[d, :-1], v[:, d], side="left")
        return out


def usable(vectors: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every vector with `width` components, none null or non-finite, and an id."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == cfg.width)).where(fine)
    whole = lambda e: F.floor(
        F.greatest(F.least(e * F.lit(float(cfg.scale)), F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def fit_grid(rows: DataFrame, cfg: ClusterConfig) -> Grid | None:
    """Cells of equal width between two outer percentiles of each dimension; the outer cells reach to the extremes.

    Percentiles are approximate, extremes exact, both over all rows; one row comes to the driver. None without rows.
    """
    marks = []
    for d in range(cfg.width):
        x = F.col("v")[d]
        marks += [F.min(x), F.max(x), F.percentile_approx(x, [cfg.tail, 1 - cfg.tail], 1000)]
    found = rows.agg(*[m.alias(f"m{i}") for i, m in enumerate(marks)]).first()
    if found[0] is None:
        return None
    inner = 2 ** cfg.bits - 2
    high = np.empty((cfg.width, inner + 2), np.int64)
    low = np.empty_like(high)
    for d in range(cfg.width):
        least, most, (a, b) = found[3 * d:3 * d + 3]
        edges = a + (b - a) * np.arange(inner + 1) // inner
        high[d] = [*edges, most]
        low[d] = [least, *(edges + 1)]
    return Grid(low, high)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def build_index(rows: DataFrame, grid: Grid, cfg: ClusterConfig) -> DataFrame:
    """(vec_id, cells, v): cells one byte a dimension, v as 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, cfg.width)
            cells = grid.cells(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in cells], pa.binary()),
                 pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "cells", "v"])
    return rows.mapInArrow(run, INDEX)


class Lookup:
    """For each dimension and cell, the least and the most that it adds to the distance to each centroid.

    What all centroids have in common, the distance to their middle, is left out: it changes no order, and the intervals
    of the rest are far narrower.
    """

    def __init__(self, grid: Grid, centroids: np.ndarray):
        self.centroids = centroids
        middle = centroids.sum(axis=0) // len(centroids)
        part = lambda x: ((x[:, :, None] - centroids.T[:, None, :]) ** 2
                          - ((x - middle[:, None]) ** 2)[:, :, None])
        ends = part(grid.low), part(grid.high)
        self.least, self.most = np.minimum(*ends), np.maximum(*ends)

    def intervals(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.zeros((len(cells), len(self.centroids)), np.int64)
        high = np.zeros_like(low)
        for d in range(cells.shape[1]):
            low += self.least[d][cells[:, d]]
            high += self.most[d][cells[:, d]]
        return low, high

    def nearest(self, cells: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest centroid of each vector, ties to the smaller number, and how many exact distances it took."""
        low, high = self.intervals(cells)
        near = low <= high.min(axis=1)[:, None]
        chosen = near.argmax(axis=1).astype(np.int32)
        open_rows = np.flatnonzero(near.sum(axis=1) > 1)
        row, centroid = np.nonzero(near[open_rows])
        if not len(row):
            return chosen, 0
        full = v[open_rows].astype(np.int64)
        exact = np.full((len(open_rows), len(self.centroids)), LARGEST)
        for at in range(0, len(row), PAIRS):
            r, c = row[at:at + PAIRS], centroid[at:at + PAIRS]
            exact[r, c] = ((full[r] - self.centroids[c]) ** 2).sum(axis=1)
        chosen[open_rows] = exact.argmin(axis=1)
        return chosen, len(row)


def cluster_sums(index: DataFrame, lookup: Lookup, cfg: ClusterConfig) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in each cluster and their sums by dimension; each task adds its own before anything is shuffled."""
    k, width = lookup.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Column `width` counts the vectors.
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            cells, v = _matrix(batch.column(0), "u1", width), _matrix(batch.column(1), "<i4", width)
            chosen, _ = lookup.nearest(cells, v)
            for c in np.unique(chosen):
                mine = v[chosen == c]
                total[c, :width] += mine.sum(axis=0, dtype=np.int64)
                total[c, width] += len(mine)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d])], ["cluster", "dimension", "total"])

    parts = index.select("cells", "v").mapInArrow(run, "cluster int, dimension int, total long")
    # At most k * (width + 1) rows, whatever the table holds.
    found = parts.groupBy("cluster", "dimension").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((k, width + 1), np.int64)
    for row in found:
        out[row["cluster"], row["dimension"]] = row["total"]
    return out[:, width], out[:, :width]


def first_centroids(rows: DataFrame, cfg: ClusterConfig) -> np.ndarray:
    """The vectors whose keyed id has the smallest digests; fewer than k where there are not so many."""
    key = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(cfg.k).collect()
    return np.array([r["v"] for r in best], dtype=np.int64).reshape(-1, cfg.width)


def fit_centroids(rows: DataFrame, index: DataFrame, grid: Grid, cfg: ClusterConfig) -> np.ndarray:
    """Centroids after cfg.rounds rounds; a round moves each to the floor of its vectors' mean, empty ones stay."""
    centroids = first_centroids(rows, cfg)
    for _ in range(cfg.rounds):
        counts, sums = cluster_sums(index, Lookup(grid, centroids), cfg)
        held = counts > 0
        centroids = centroids.copy()
        centroids[held] = sums[held] // counts[held][:, None]
    return centroids


def assign(index: DataFrame, lookup: Lookup) -> DataFrame:
    """(vec_id, cluster, distance): every vector's nearest centroid and its squared distance."""
    width = lookup.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, v = _matrix(batch.column(1), "u1", width), _matrix(batch.column(2), "<i4", width)
            chosen, _ = lookup.nearest(cells, v)
            distance = ((v - lookup.centroids[chosen]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chosen), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return index.mapInArrow(run, ASSIGNED)


def cluster_vectors(vectors: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    Reads vec_id and embedding only. Vectors that are null, hold a null or non-finite component, have another number of
    components or no id are left out. Rows that repeat an id are vectors of their own. Components are floor(scale * x),
    those beyond 2**27 count as that bound. With fewer vectors than cfg.k there are as many centroids as vectors.
    Inertias beyond 64 bits are shown as the largest 64-bit integer. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, cfg)
    grid = fit_grid(rows, cfg)
    if grid is None:
        return spark.createDataFrame([], RESULT)
    index = stage(build_index(rows, grid, cfg), "va-file")
    centroids = fit_centroids(rows, index, grid, cfg)
    assigned = stage(assign(index, Lookup(grid, centroids)), "va-assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(exact).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    inertia = min(LARGEST, sum(totals.values()))
    about = [Row(cluster=c, cluster_inertia=min(LARGEST, n), inertia=inertia, centroid_sha256=digest(centroids[c]))
             for c, n in totals.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most cfg.k rows.
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
