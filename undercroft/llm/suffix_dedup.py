"""Removal of every byte that lies in a long string which also starts somewhere else in the corpus.

Windows of `length` bytes are told apart by suffix sorting, but only where a repeat is possible: each window has an
anchor, the smallest hash among its short grams, and equal windows have equal anchors. Grams that occur once in the
corpus rule their windows out. What is left is cut into slices by anchor, equal slices are merged, slices are dealt to
shards by anchor, and each shard is ordered by external induced sorting (`induced`). Slices of a frequent anchor are cut
in two and dealt by the bytes beside the anchor as well, which equal windows share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.llm.induced import suffix_order
from undercroft.session import stage

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text that are looked at together; positions inside take 20 bits.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class RepeatConfig:
    length: int = 200
    #: Bytes of a gram, a power of two, and one in how many grams is checked beside the anchors.
    gram: int = 32
    sampled: int = 64
    #: Bits of the table of repeated grams; a fuller table lets more slices through to the sort, nothing else.
    bits: int = 1 << 28
    #: An anchor is hot when it has more than this many slices, and more than one part in `hot_share` of all.
    hot: int = 500
    hot_share: int = 1_000_000
    #: Bytes of slices in a shard, about.
    shard: int = 64 << 20
    #: Bytes of slices that are sorted at once, about, and of bucket queues that the sort holds in memory.
    sort_bytes: int = 1 << 20
    memory: int = 8 << 20
    #: Bytes of slices that a task remembers for merging before it passes them on, about.
    flush: int = 4 << 20


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all grams of `gram` bytes (a power of two)."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    h, size, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x100000001B3
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = size * 2, factor * factor & 0xFFFFFFFFFFFFFFFF
    h *= _MIX
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` grams the place of the smallest, the leftmost of equals."""
    n = len(h) - span + 1
    key = (h & ~np.uint64(_BLOCK - 1)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        key = np.minimum(key[:len(key) - size], key[size:])
        size *= 2
    low = np.minimum(key[:n], key[span - size:span - size + n])
    return (low & np.uint64(_BLOCK - 1)).astype(np.int64)


def _blocks(data: bytes, cfg: RepeatConfig) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) so that every window lies in exactly one block."""
    step = _BLOCK - cfg.length
    for at in range(0, max(1, len(data) - cfg.length + 1), step):
        yield at, np.frombuffer(data, np.uint8, min(len(data) - at, step + cfg.length - 1), at)


def _count_grams(cfg: RepeatConfig):
    limit, span = np.uint64(2 ** 64 // cfg.sampled), cfg.length - cfg.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = 0, []

        def drain():
            keys, n = np.unique(np.concatenate(waiting) if waiting else np.zeros(0, np.uint64), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])

        for batch in batches:
            for text in batch.column(0):
                data = text.as_buffer() if text.is_valid else b""
                if len(data) < cfg.length:
                    continue
                places = []
                for at, block in _blocks(data, cfg):
                    if len(block) < cfg.length:
                        continue
                    h = gram_hashes(block, cfg.gram)
                    seen = h < limit
                    seen[anchors(h, span)] = True
                    seen = np.flatnonzero(seen)
                    places.append(np.stack([seen + at, h[seen].view(np.int64)]))
                # Blocks overlap; a place counts once.
                place, gram = np.concatenate(places, axis=1) if len(places) > 1 else places[0]
                if len(places) > 1:
                    _, first = np.unique(place, return_index=True)
                    gram = gram[first]
                waiting.append(gram.view(np.uint64))
                held += len(gram)
                if held > 1_000_000:
                    held = 0
                    yield drain()
        yield drain()
    return run


def _bitmap(grams: DataFrame, bits: int) -> bytes:
    """A table of `bits` bits with those of the given grams set; its size is fixed."""
    at = F.expr(f"pmod(gram, {bits}L) + 1")
    found = grams.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = bytearray(bits // 8)
    for row in found.toLocalIterator(prefetchPartitions=True):  # bits / 32768 rows at most
        start = (row["bucket"] - 1) * 4096
        out[start:start + 4096] = row["bits"]
    return bytes(out)


CANDIDATES = ("gram long, slice_id long, copies long, slice binary, anchor int, text_key long, size long, starts array<long>, "
              "counts array<int>, ids array<long>")


def _cut_slices(cfg: RepeatConfig, table):
    """Two kinds of rows: a distinct slice (gram, slice_id, copies, slice, anchor: the anchor's place in it), and a text's
    slices (text_key, size, ...)."""
    limit, span = np.uint64(2 ** 64 // cfg.sampled), cfg.length - cfg.gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table.value, np.uint8)
        slices: dict[int, list] = {}
        texts: dict[tuple[int, int], tuple[list, list, list]] = {}
        held = 0

        def drain():
            n, m = len(slices), len(texts)
            none = [None]
            columns = [
                [s[0] for s in slices.values()] + none * m, [*slices, *none * m],
                *[[s[k] for s in slices.values()] + none * m for k in (1, 2, 3)],
                none * n + [k for k, _ in texts], none * n + [z for _, z in texts],
                *[none * n + [t[i] for t in texts.values()] for i in range(3)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(),
                     pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            names = ["gram", "slice_id", "copies", "slice", "anchor", "text_key", "size", "starts", "counts", "ids"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            slices.clear()
            texts.clear()
            return batch

        for batch in batches:
            for text, key in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_buffer() if text.is_valid else b""
                if len(data) < cfg.length:
                    continue
                known = texts.get((key, len(data)))
                if known is not None:  # a copy of a text this task has cut
                    for i in known[2]:
                        slices[i][1] += 1
                    continue
                data = bytes(data)
                starts, counts, ids = [], [], []
                for at, block in _blocks(data, cfg):
                    if len(block) < cfg.length:
                        continue
                    h = gram_hashes(block, cfg.gram)
                    place = anchors(h, span)
                    slot = (h.view(np.int64) % cfg.bits)
                    repeated = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
                    # A sampled gram that is nowhere else rules out all windows that hold it.
                    alone = np.concatenate(([0], np.cumsum((h < limit) & ~repeated)))
                    able = repeated[place] & (alone[span:] == alone[:len(place)])
                    if not able.any():
                        continue
                    value = np.where(able, place, -1)
                    edge = np.flatnonzero(np.diff(value)) + 1
                    first = np.concatenate(([0], edge))
                    last = np.concatenate((edge, [len(value)]))
                    for a, b in zip(first.tolist(), last.tolist()):
                        if value[a] < 0:
                            continue
                        piece = data[at + a:at + b - 1 + cfg.length]
                        gram = int(h[value[a]].view(np.int64))
                        # The place of the anchor in the slice tells slices with equal bytes and other anchors apart.
                        i = xxhash.xxh3_64_intdigest(piece, seed=int(value[a]) - a) - (1 << 63)
                        if i in slices:
                            slices[i][1] += 1
                        else:
                            slices[i] = [gram, 1, piece, int(value[a]) - a]
                            held += len(piece)
                        starts.append(at + a)
                        counts.append(b - a)
                        ids.append(i)
                texts[(key, len(data))] = (starts, counts, ids)
                held += 24 * len(starts) + 64
                if held > cfg.flush:
                    held = 0
                    yield drain()
        yield drain()
    return run


def _sort_shard(cfg: RepeatConfig):
    """Slices in the order of their keys -> (slice_id, first, last): runs of window starts that repeat.

    Spark has sorted the shard, on disk where it is large; here keys are gathered until their slices are worth a
    sort, so a task holds cfg.sort_bytes of slices and one key's more, whatever the shard holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        mixed: list[tuple[int, int, int, bytes]] = []

        def close(group: dict[bytes, list]) -> None:
            for piece, (copies, places) in group.items():
                if copies > 1:  # every window of a slice that is there twice repeats
                    for i, shift in places:
                        for column, value in zip(out, (i, shift, shift + len(piece) - cfg.length)):
                            column.append(value)
            # Keys with one slice, or with copied slices only, need no order.
            if len(group) > 1 and any(copies == 1 for copies, _ in group.values()):
                mixed.extend((*next(iter(places)), copies, piece) for piece, (copies, places) in group.items())

        def sort() -> None:
            if not mixed:
                return
            text = np.frombuffer(b"".join(piece + b"\0" for *_, piece in mixed), np.uint8).astype(np.uint16) + np.uint16(2)
            sizes = np.array([len(piece) for *_, piece in mixed])
            begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
            text[begins + sizes] = 1
            order, common = suffix_order(np.append(text, np.uint16(0)), 258, cfg.memory)
            same = common >= cfg.length
            same[:-1] |= same[1:]
            starts = np.zeros(len(order), dtype=bool)
            starts[order[same]] = True
            for (i, shift, copies, piece), begin in zip(mixed, begins.tolist()):
                if copies == 1:
                    window = starts[begin:begin + len(piece) - cfg.length + 1]
                    flip = np.flatnonzero(np.diff(np.concatenate(([0], window.view(np.int8), [0]))))
                    for a, b in zip(flip[::2].tolist(), flip[1::2].tolist()):
                        for column, value in zip(out, (i, shift + a, shift + b - 1)):
                            column.append(value)
            mixed.clear()

        def drain() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["slice_id", "first", "last"])
            for column in out:
                column.clear()
            return batch

        group: dict[bytes, list] = {}
        now, held = None, 0
        for batch in batches:
            for gram, i, copies, piece, shift in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if gram != now:
                    close(group)
                    group, now = {}, gram
                    if held > cfg.sort_bytes:
                        sort()
                        held = 0
                        yield drain()
                known = group.get(piece)
                if known is None:
                    group[piece] = [copies, {(i, shift): None}]
                    held += len(piece)
                else:
                    known[0] += copies
                    known[1][i, shift] = None
        close(group)
        sort()
        yield drain()
    return run


SLICES = "gram long, slice_id long, copies long, slice binary, shift int"


def _cut_hot(cfg: RepeatConfig):
    """Slices of frequent anchors, each cut in two: windows that begin less than `reach` bytes before the anchor hold as
    many bytes behind it, the others hold as many before it. Equal windows share those bytes, so they and the anchor
    are the key. `shift` is the place of the part in the slice."""
    reach = (cfg.length - cfg.gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for gram, i, copies, piece, at in zip(*(batch.column(k).to_pylist() for k in range(5))):
                middle = max(0, at - reach)
                parts = [(middle, len(piece), piece[at + cfg.gram:at + cfg.gram + reach], 1)]
                if middle:
                    parts.append((0, middle - 1 + cfg.length, piece[at - reach:at], 0))
                for first, stop, beside, side in parts:
                    if stop - first >= cfg.length:
                        key = xxhash.xxh3_64_intdigest(gram.to_bytes(8, "little", signed=True) + beside, seed=side) - (1 << 63)
                        for column, value in zip(out, (key, i, copies, piece[first:stop], first)):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["gram", "slice_id", "copies", "slice", "shift"])
    return run


def _text_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("data"),
                       F.xxhash64(text).alias("text_key"))


def repeated_spans(docs: DataFrame, cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """(text_key, size, runs): for each text the runs (first, last) of starts of windows that also start elsewhere."""
    spark = docs.sparkSession
    rows = _text_rows(docs).where(F.length("data") >= cfg.length)
    counts = rows.select("data").mapInArrow(_count_grams(cfg), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = stage(counts.where("n > 1"), "repeat-grams")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most hot_share grams can have one part in hot_share of all.
    hot = counts.where(F.col("n") > max(cfg.hot, total // cfg.hot_share)).select("gram")
    table = spark.sparkContext.broadcast(_bitmap(counts.select("gram"), cfg.bits))
    found = stage(rows.select("data", "text_key").mapInArrow(_cut_slices(cfg, table), CANDIDATES), "repeat-slices")
    slices = found.where("slice is not null").select("gram", "slice_id", "copies", "slice", "anchor")
    hot = F.broadcast(hot)
    cold = slices.join(hot, "gram", "left_anti").select("gram", "slice_id", "copies", "slice", F.lit(0).alias("shift"))
    keyed = cold.unionAll(slices.join(hot, "gram", "left_semi").mapInArrow(_cut_hot(cfg), SLICES))
    # A repeated gram leads one slice of up to twice the window; shards are as many as keep their slices small.
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 2 * cfg.length // cfg.shard + 1)
    sorted_runs = keyed.repartition(shards, "gram").sortWithinPartitions("gram").mapInArrow(
        _sort_shard(cfg), "slice_id long, first int, last int")
    runs = stage(sorted_runs, "repeat-runs")
    uses = found.where("text_key is not null").select(
        "text_key", "size", F.explode(F.arrays_zip("starts", "ids")).alias("s")).select(
        "text_key", "size", F.col("s.starts").alias("start"), F.col("s.ids").alias("slice_id"))
    spans = uses.join(runs, "slice_id").select(
        "text_key", "size", F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")).alias("run"))
    return spans.groupBy("text_key", "size").agg(F.collect_set("run").alias("runs"))


def _remove(cfg: RepeatConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = bytes(text.as_buffer())
                kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
                end = -1
                for first, last in sorted((r["first"], r["last"]) for r in runs or ()):
                    stop = last + cfg.length
                    if first > end:  # not touching the run before
                        spans += 1
                        kept.update(data[at:first])
                        removed += stop - first
                        at = end = stop
                    elif stop > end:
                        removed += stop - end
                        at = end = stop
                kept.update(data[at:])
                for column, value in zip(out, (doc, len(data), removed, spans, kept.hexdigest())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def remove_repeats(docs: DataFrame, cfg: RepeatConfig = RepeatConfig()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when it lies in a string of cfg.length bytes that also starts anywhere else in the corpus, the same
    document included. Null texts are empty; shorter texts keep all bytes; repeated rows are copies of each other and
    lose all windows; null ids are kept; an empty table gives no rows; other columns are not read.
    """
    spans = repeated_spans(docs, cfg)
    rows = _text_rows(docs).withColumn("size", F.length("data").cast("long"))
    joined = rows.join(spans, ["text_key", "size"], "left").select("doc_id", "data", "runs")
    return joined.mapInArrow(_remove(cfg), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
