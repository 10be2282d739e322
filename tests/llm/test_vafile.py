"""Clustering over the approximation file against plain k-means on integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from undercroft.llm import vafile
from undercroft.llm.vafile import ClusterConfig, Grid, Lookup

VECTORS = "vec_id long, embedding array<float>, v string, cells int, cluster int"


def usable(rows, cfg):
    out = []
    for i, x in rows:
        if i is None or x is None or len(x) != cfg.width or any(c is None or not math.isfinite(c) for c in x):
            continue
        scaled = [math.floor(cfg.scale * float(np.float32(c))) for c in x]
        out.append((i, [max(-vafile.BOUND, min(vafile.BOUND, c)) for c in scaled]))
    return out


def nearest(v, centroids):
    d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
    return d.index(min(d)), min(d)


def brute(rows, cfg):
    kept = usable(rows, cfg)
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{cfg.seed}:{r[0]}".encode()).hexdigest(), r[1]))[:cfg.k]
    centroids = [v for _, v in first]
    for _ in range(cfg.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v, centroids)[0], []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else old
                     for c, old in enumerate(centroids)]
    found = [(i, *nearest(v, centroids)) for i, v in kept]
    by = {}
    for _, c, d in found:
        by[c] = by.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, by[c], sum(by.values()), digest[c]) for i, c, d in found)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "x", 1, 2) for i, x in rows], VECTORS)


@pytest.mark.parametrize("seed, bits", [(1, 2), (2, 6), (3, 8)])
def test_against_plain_clustering(spark, seed, bits):
    cfg = ClusterConfig(k=7, rounds=4, width=5, bits=bits)
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([0.0, rnd.gauss(0, 0.3), rnd.gauss(2, 1)]) for _ in range(5)]) for i in range(200)]
    # A third are copies of one vector, and some differ in one step: ties and empty clusters.
    rows += [(1000 + i, rows[3][1]) for i in range(100)] + [(2000 + i, [0.0, 0.0, 0.0, 0.0, i / 256]) for i in range(9)]
    rows += [(3000, None), (3001, [1.0] * 4), (3002, [1.0] * 6), (3003, [None] * 5), (3004, [float("nan")] * 5),
             (3005, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5), (3006, []), (5, [0.5] * 5), (5, [0.5] * 5)]
    got = sorted(map(tuple, vafile.cluster_vectors(frame(spark, rows), cfg).collect()))
    assert got == brute(rows, cfg)


def test_extremes_and_small_tables(spark):
    cfg = ClusterConfig(k=5, rounds=2, width=2)
    for rows in ([(1, [3e38, -3e38]), (2, [0.0, 0.0]), (3, [1e6, 2.0]), (4, [3e38, -3e38])], [(9, [1.0, 1.0])]):
        got = sorted(map(tuple, vafile.cluster_vectors(frame(spark, rows), cfg).collect()))
        want = [(*r[:3], min(vafile.LARGEST, r[3]), min(vafile.LARGEST, r[4]), r[5]) for r in brute(rows, cfg)]
        assert got == want
    for rows in ([], [(1, None)], [(1, [1.0])]):
        empty = vafile.cluster_vectors(frame(spark, rows), cfg)
        assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert empty.count() == 0


@pytest.mark.parametrize("bits", [3, 6])
def test_intervals_hold_and_spare_work(bits):
    """Every relative distance lies inside its interval, and few of all exact distances are needed."""
    rnd = np.random.default_rng(4)
    centres = rnd.integers(-200, 200, (12, 16))
    v = (centres[rnd.integers(0, 12, 4000)] + rnd.integers(-20, 21, (4000, 16))).astype(np.int64)
    inner = 2 ** bits - 2
    low, high = np.empty((16, inner + 2), np.int64), np.empty((16, inner + 2), np.int64)
    for d in range(16):
        a, b = np.percentile(v[:, d], [1, 99]).astype(int)
        edges = a + (b - a) * np.arange(inner + 1) // inner
        high[d], low[d] = [*edges, v[:, d].max()], [v[:, d].min(), *(edges + 1)]
    grid = Grid(low, high)
    cells = grid.cells(v)
    at = np.arange(16)
    assert ((low[at, cells] <= v) & (v <= high[at, cells])).all()
    lookup = Lookup(grid, centres)
    least, most = lookup.intervals(cells)
    exact = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    middle = centres.sum(axis=0) // len(centres)
    relative = exact - ((v - middle) ** 2).sum(axis=1)[:, None]
    assert (least <= relative).all() and (relative <= most).all()
    chosen, work = lookup.nearest(cells, v)
    assert (chosen == exact.argmin(axis=1)).all()
    assert work < (0.5 if bits == 3 else 0.05) * exact.size
