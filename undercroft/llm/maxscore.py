"""Exact top-k by integer inner product with MaxScore, over a grid of shards and query blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.llm.common import parallelism
from undercroft.session import stage

SCALE = 256
#: Rows of a shard and of a query block at most, about; a cell of the grid holds one of each.
SHARD_ROWS = 4096
BLOCK_ROWS = 2048
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, x as double.

    Vectors that are null or hold a null or non-finite component are left out, as are rows without an id. Rows that
    repeat an id count once (the smallest vector by components), so that ids stay unique. Products that leave the
    range of a 64-bit integer are clipped to it.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows as a matrix; shorter vectors are filled up with zeros."""
    array = column.combine_chunks()
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = array.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def search_shard(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int, high: np.ndarray, low: np.ndarray,
                 floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a shard for one query: (positions, scores), best first, ties to the smaller id.

    A term is a component; its list is the shard's column. Of what a term can add, the least is sure for every row, and
    its span, the most less the least, is what a row may gain by it. Terms are non-essential, smallest spans first, as
    long as their spans together stay under what a row must gain to reach the k-th best score known: a row that gains
    nothing by the others cannot. Essential lists are traversed for all rows; each other list is probed, largest span
    first, for the rows that can still compete. `floor` is a score that k rows elsewhere are known to reach; rows under it
    may be left out.
    """
    use = np.flatnonzero(ids != query_id)
    k = min(k, len(use))
    if not k:
        return use[:0], np.zeros(0, np.int64)
    lists = x.T
    most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    order = np.argsort(-(most - least), kind="stable")
    # rest[i], gain[i]: the most that the terms order[i:] can still add, and the most that a row can gain by them.
    rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)
    gain = np.append(np.cumsum((most - least)[order][::-1])[::-1], 0)
    sure = q @ lists[:, use[:max(4 * k, 32)]]
    threshold = np.partition(sure, len(sure) - k)[len(sure) - k]
    if floor is not None:
        threshold = max(threshold, floor)
    essential = int(np.argmax(gain < max(threshold - least.sum(), 0))) if gain[-1] < threshold - least.sum() else len(order)
    score = (q[order[:essential]] @ lists[order[:essential]])[use] if essential else np.zeros(len(use), x.dtype)
    for i in range(essential, len(order) + 1):
        keep = score + rest[i] >= threshold
        if not keep.all():
            use, score = use[keep], score[keep]
        if len(use) <= 4 * k:
            score = score + q[order[i:]] @ lists[np.ix_(order[i:], use)]
            break
        if i < len(order):
            score = score + lists[order[i], use] * q[order[i]]
    best = np.lexsort((ids[use], -score))[:k]
    return use[best], score[best]


def _cell(k: int):
    def run(key, shard: pa.Table, block: pa.Table) -> pa.Table:
        ids, qids = (t.column("vec_id").to_numpy() for t in (shard, block))
        found: tuple[list, list, list] = ([], [], [])
        if len(ids) and len(qids):
            x, qs = _matrix(shard.column("v")), _matrix(block.column("v"))
            width = max(x.shape[1], qs.shape[1])
            x, qs = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, qs))
            peak = float(np.abs(x).max(initial=0)) * float(np.abs(qs).max(initial=0)) * max(1, width)
            # Whole numbers are exact in doubles up to 2**53, bounds included.
            kind = float if peak < 2.0 ** 50 else np.int64 if peak < 2.0 ** 60 else object
            x, qs = np.asfortranarray(x.astype(kind)), qs.astype(kind)
            high, low = (x.max(axis=0), x.min(axis=0)) if width else (np.zeros(0, np.int64),) * 2
            for qid, q, floor in zip(qids, qs, block.column("floor").to_pylist()):
                at, score = search_shard(ids, x, qid, q, k, high, low, floor)
                found[0].extend([int(qid)] * len(at))
                found[1].extend(ids[at].tolist())
                found[2].extend(max(-2 ** 63, min(2 ** 63 - 1, int(s))) for s in score)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), found)})
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
          ) -> DataFrame:
    """The k best rows of `vectors` (vec_id, v) for every row of `queries`, never the query itself.

    Columns query_id, rank (from 1), vec_id, score; fewer than k rows where there are not so many. Vectors are dealt
    to shards and queries to blocks by a hash of the id; each pair of a shard and a block is one task of bounded size.
    The first shard is searched first; the k-th best score that a query finds there goes with the query to the other
    shards. Every shard gives its k best, and the best of those are the answer. Shorter vectors count as filled up with
    zeros. An empty side gives no rows. Inputs are read several times, so give written tables.
    """
    spark = vectors.sparkSession
    n, m = vectors.count(), queries.count()
    shards = max(1, min(n, max(-(-n // shard_rows), 4 * parallelism(spark))))
    blocks = max(1, -(-m // block_rows))
    deal = lambda parts: F.expr(f"cast(pmod(xxhash64(vec_id), {parts}) as int)")
    every = lambda first, last: F.explode(F.sequence(F.lit(first), F.lit(last)))
    left = vectors.select("vec_id", "v", deal(shards).alias("shard"), every(0, blocks - 1).alias("block"))
    asked = queries.select("vec_id", "v", deal(blocks).alias("block"))

    def search(some: DataFrame, first: int, last: int, floors: DataFrame | None) -> DataFrame:
        right = asked.withColumn("floor", F.lit(None).cast("long")) if floors is None else asked.join(floors, "vec_id", "left")
        right = right.select("vec_id", "v", "block", "floor", every(first, last).alias("shard")).toDF(
            "vec_id", "v", "block", "floor", "shard")
        return some.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_cell(k), FOUND)

    found = stage(search(left.where("shard = 0"), 0, 0, None), "first-shard")
    if shards > 1:
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(
            F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("vec_id", "floor")
        found = found.unionAll(search(left.where("shard > 0"), 1, shards - 1, floors))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def search_table(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """Queries are the vectors whose id is divisible by `every`, candidates all vectors."""
    rows = stage(quantised(vectors, scale), "vectors")
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
