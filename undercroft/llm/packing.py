"""Best-two-fit packing of token documents into sequences of a fixed length.

The plan is made on the histogram of piece lengths, which has at most `capacity` rows whatever the corpus holds; the
pieces themselves are ranked per length and sent to their place by a lookup, so no piece passes through the driver.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.session import stage

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that a ranking task sorts, about.
RANK_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, encoded by tiktoken: same merges and ids, several times faster.

    Texts holding the literal string of a special token are left to the tokenizers library (see `encode`).
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # tokenizers files write bytes as printable characters: those that are printable stand for themselves, the others
    # are counted up from 256.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain}
    to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(path), tuple(special)


def encode(text: str, path: str) -> list[int]:
    """Token ids as the tokenizers library gives them with add_special_tokens=False."""
    fast, exact, special = encoder(path)
    if any(s in text for s in special):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or "", path), end_id], dtype="<u4")
                at, piece = 0, 0
                while at < len(ids):
                    size = min(capacity, len(ids) % capacity or capacity) if piece == 0 else capacity
                    part = (doc, piece, at, size, zlib.crc32(ids[at:at + size].tobytes()))
                    for column, value in zip(out, part):
                        column.append(value)
                    at, piece = at + size, piece + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every document as its ids and the end id, cut into pieces of `capacity` where longer; the first piece is the
    short one. Null texts count as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, end_id, capacity), PIECES)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins for `counts[length]` pieces of each length: (how many bins alike, their lengths).

    A bin is filled greedily with the largest piece that fits, until none does. Then its smallest piece is given back
    if two unpacked pieces together fit the gap left by it more tightly. Bins that come out alike are made at once, as
    many as the counts allow, so the work depends on the number of lengths and not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    plan: list[tuple[int, list[int]]] = []
    while left:
        lengths = sorted(left)
        used: dict[int, int] = {}
        filled: list[int] = []

        def free(n: int) -> int:
            return left.get(n, 0) - used.get(n, 0)

        gap = capacity
        for n in reversed(lengths):
            take = min(gap // n, free(n))
            if take:
                filled += [n] * take
                used[n] = used.get(n, 0) + take
                gap -= n * take
        smallest = filled[-1]
        best, pair = smallest, None
        # The two ends walk towards each other over the lengths that still have pieces.
        open_lengths = [n for n in lengths if free(n) > 0]
        low, high = 0, len(open_lengths) - 1
        while low <= high and gap:
            a, b = open_lengths[low], open_lengths[high]
            if a + b > gap + smallest:
                high -= 1
                continue
            if a + b > best and (a != b or free(a) >= 2):
                best, pair = a + b, (a, b)
            low += 1
        if pair:
            filled.pop()
            used[smallest] -= 1
            for n in pair:
                filled.append(n)
                used[n] = used.get(n, 0) + 1
        times = min(left[n] // u for n, u in used.items() if u)
        plan.append((times, filled))
        for n, u in used.items():
            left[n] -= u * times
            if not left[n]:
                del left[n]
    return plan


def _places(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, offset) sorted by length and rank: where the pieces of each rank go."""
    rows, taken, first = [], {}, 0
    for times, lengths in plan:
        offset = 0
        for n in lengths:
            rows.append((n, taken.get(n, 0), first, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        first += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32).

    Pieces of one length are ranked in slices of about RANK_ROWS rows, so a length that a third of all pieces have is
    ranked by many tasks. The plan that every task gets has a row for each slot of each kind of bin; kinds are bounded
    by the lengths (each uses one up), not by the pieces. Repeated rows are packed each; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    pieces = stage(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(best_two_fit(counts, capacity))
    slices = max(32, -(-sum(counts.values()) // RANK_ROWS))
    sliced = pieces.withColumn("slice", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {slices})"))
    before = (
        sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(
            Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    )
    order = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = sliced.withColumn("rank", F.row_number().over(order) - 1).join(before, ["length", "slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32",
                           (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    shared = spark.sparkContext.broadcast(places)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] << 45 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(key, length.astype(np.int64) << 45 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(locate, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Documents -> packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null or empty texts give one piece holding the end id; documents repeated under one doc_id are packed each; a null
    doc_id stays null; columns beside doc_id and text are not read; an empty table gives no rows.
    """
    return pack(token_pieces(docs, path, end_id, capacity), capacity)
