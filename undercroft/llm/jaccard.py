"""Exact n-gram Jaccard join that skips by the relations between sets.

Sets that are equal are one class. Classes meet in block-skip index lists: a list holds the classes that have one
shingle in their prefix, cut into blocks by set size, so that a class meets the one block whose sizes can reach the
threshold, and by position, as a pair needs a common shingle in the shallow part of the smaller set. A class is first
compared with the heads of its lists only. What is known of a head's overlaps then decides or bounds the overlaps of
the classes that are highly similar to it, and only pairs left open by that are compared themselves. Before whole sets
are sent to any pair, small bitmaps of both sets bound its overlap from above; most pairs that do not link go there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undercroft.llm.common import components
from undercroft.session import stage

_BASE = 0x9E3779B97F4A7C15


def _byte_codes() -> np.ndarray:
    """A number for each byte, the same for A-Z and a-z; white space is told apart by `_SPACE`."""
    x = np.arange(256, dtype=np.uint64)
    x[65:91] += np.uint64(32)
    x = (x + np.uint64(1)) * np.uint64(_BASE)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


_CODES = _byte_codes()
#: Fixed value: what parts words, the space and the bytes 9 to 13. All are ASCII, so bytes can be looked at.
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size, np.uint64(f), np.uint64))))
                for f in (_BASE, inverse))


#: A shingle seen fewer times than this is rare.
_LEAST = 8


@dataclass(frozen=True)
class JaccardConfig:
    #: Words of a shingle; sets link when den * intersection >= num * union.
    words: int = 4
    num: int = 85
    den: int = 100
    #: Most shingles whose frequency is told to all tasks, so that frequent ones come last in every prefix. Which ones
    #: they are changes the work, never the result.
    frequent: int = 4_000_000
    #: Heads that a class is compared with in the first pass.
    heads: int = 2

    def need(self, n: int) -> int:
        """Least intersection of a set of n with any other that it links to."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.need(n) + 1


def shingles(data, words: int, powers: Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text in UTF-8; a shorter text is one shingle.

    A word's hash is a difference of running sums of its bytes' codes times powers of the base, shifted to the start.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[~space[edge]], edge[space[edge]]
    if not space[0]:
        starts = np.concatenate(([0], starts))
    if not space[-1]:
        ends = np.append(ends, len(raw))
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers.reach(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_CODES[raw] * powers.down[:len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers.up[starts] + (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(32)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):  # a hash of the sequence: exclusive or, multiply, shift
        out = (out ^ h[i:len(h) - size + 1 + i]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(tokens: np.ndarray) -> bytes:
    """Bits of the remainders of the hashes by a power of two, two to four bits for each hash."""
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[tokens & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(a: bytes, na: int, b: bytes, nb: int) -> int:
    """Upper bound of the overlap of two sets from their bitmaps: a bit that only one has is a hash that only it has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(min(na - np.bitwise_count(x & ~y).sum(), nb - np.bitwise_count(y & ~x).sum()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Repeats:
    """Counts of the values that are seen again; what is seen once leaves a bit only, and most shingles are.

    A value whose bit another one has set before counts once too many. At most 4 * share values are held.
    """

    def __init__(self, share: int):
        self.share, self.total, self._held = share, 0, 0
        self._keys, self._counts = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self._waiting: list[np.ndarray] = []
        self._seen = np.zeros(1 << 24, np.uint8)

    def add(self, values: np.ndarray) -> None:
        self._waiting.append(values)
        self._held += len(values)
        self.total += len(values)
        if self._held > 500_000:
            self._fold()

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        self._fold()
        return self._keys, self._counts

    def _fold(self) -> None:
        if not self._held:
            return
        new, n = np.unique(np.concatenate(self._waiting), return_counts=True)
        self._waiting, self._held = [], 0
        at, bit = (new >> np.uint64(40)).astype(np.int64), np.uint8(1) << (new >> np.uint64(37) & np.uint64(7)).astype(np.uint8)
        before = self._seen[at] & bit != 0
        first = np.flatnonzero(np.diff(at, prepend=-1))  # the values are sorted, so those of one byte are neighbours
        self._seen[at[first]] |= np.bitwise_or.reduceat(bit, first)
        again = before | (n > 1)
        new, n = new[again], (n + before)[again].astype(np.uint32)
        where = np.searchsorted(self._keys, new)
        known = np.zeros(len(new), bool)
        known[where < len(self._keys)] = self._keys[where[where < len(self._keys)]] == new[where < len(self._keys)]
        self._counts[where[known]] += n[known] - np.uint32(1)
        self._keys = np.insert(self._keys, where[~known], new[~known])
        self._counts = np.insert(self._counts, where[~known], n[~known])
        if len(self._keys) > 4 * self.share:  # rare ones go, as in lossy counting, so that memory stays bounded
            least = np.partition(self._counts, len(self._counts) - 2 * self.share)[len(self._counts) - 2 * self.share]
            keep = self._counts > least
            self._keys, self._counts = self._keys[keep], self._counts[keep]


def frequent_shingles(docs: DataFrame, cfg: JaccardConfig) -> np.ndarray:
    """Shingles that make up at least one part in cfg.frequent of all, with their counts: cfg.frequent at most.

    A shingle with that share of all has that share in some task, so each task reports those it sees at least that
    often among its own (_LEAST / 4 times at least), and the reports are summed. Of the sums at most cfg.frequent can
    reach the share; those under _LEAST are no matter.
    """
    share = cfg.frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, repeats = Powers(), Repeats(share)
        for batch in batches:
            for text in batch.column(0):
                repeats.add(shingles(text.as_buffer() if text.is_valid else b"", cfg.words, powers))
        keys, counts = repeats.counts()
        keep = counts >= max(_LEAST // 4, repeats.total // share)
        yield pa.RecordBatch.from_pydict({"shingle": pa.nulls(1, pa.int64()), "n": pa.array([repeats.total], pa.int64())})
        found = pa.RecordBatch.from_arrays(
            [pa.array(keys[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], ["shingle", "n"])
        for start in range(0, found.num_rows, 100_000):
            yield found.slice(start, 100_000)

    counted = _texts(docs).select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = stage(counted, "jaccard-frequent")
    total = counted.where("shingle is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counted.where("shingle is not null").where(F.col("n") >= max(_LEAST, -(-total // share))).toArrow()
    return np.stack([top.column(0).to_numpy(), top.column(1).to_numpy()]) if top.num_rows else np.zeros((2, 0), np.int64)


def describe(docs: DataFrame, frequent: np.ndarray, cfg: JaccardConfig, sets: bool = False, only: bytes = b"") -> DataFrame:
    """(doc_id, cls, n, tokens, sketch): class key, size and either the prefix, rare shingles first, and the set's bitmap,
    or the whole set sorted.

    Equal sets have equal keys; the key is a 64-bit hash like the shingles. Texts without words have a null class.
    `only` has a bit for the remainder of each doc_id by BITS; rows whose bit is off are passed over.
    """
    by_key = frequent[:, np.argsort(frequent[0])]
    shared = docs.sparkSession.sparkContext.broadcast(by_key)
    wanted = docs.sparkSession.sparkContext.broadcast(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        keys, counts = shared.value
        bits = np.frombuffer(wanted.value, np.uint8) if wanted else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for doc, text in zip(ids, batch.column(1)):
                if bits is not None and doc is not None and not bits[doc % BITS >> 3] >> (doc % 8) & 1:
                    continue
                s = shingles(text.as_buffer() if text.is_valid else b"", cfg.words, powers)
                n = len(s)
                tokens = s
                if n and not sets:
                    signed = s.view(np.int64)
                    at = np.minimum(np.searchsorted(keys, signed), max(0, len(keys) - 1))
                    seen = np.where(keys[at] == signed, counts[at], 0) if len(keys) else np.zeros(n, np.int64)
                    tokens = s[np.lexsort((s, seen))[:cfg.prefix(n)]]
                out[0].append(doc)
                out[1].append(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64) if n else None)
                out[2].append(n)
                out[3].append(tokens.view(np.int64))
                out[4].append(sketch(s) if n and not sets else None)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, out[3])]), pa.int32()),
                pa.array(np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), lists,
                 pa.array(out[4], pa.binary())],
                ["doc_id", "cls", "n", "tokens", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id long, cls long, n long, tokens array<long>, sketch binary")


#: Size of the table of wanted documents; a document whose remainder is shared by a wanted one costs time only.
BITS = 1 << 24


def _bitmap(ids: DataFrame) -> bytes:
    """BITS bits, those of the given ids set: a table of fixed size, whatever the number of ids."""
    at = F.expr(f"pmod(doc_id, {BITS}) + 1")
    found = ids.where("doc_id is not null").select(at.alias("at")).groupBy(
        F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = bytearray(BITS // 8)
    for row in found.collect():  # at most BITS / 32768 rows
        start = (row["bucket"] - 1) * 4096
        out[start:start + 4096] = row["bits"]
    return bytes(out)


def _sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """(cls, n, tokens): the whole sets of the classes in the columns a and b of `pairs`, read from the texts again."""
    some = stage(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(
        classes.select("cls", "doc_id"), "cls"), "jaccard-some")
    sets = describe(docs, np.zeros((2, 0), np.int64), cfg, sets=True, only=_bitmap(some.select("doc_id")))
    first = some.select(F.col("cls").alias("c"), F.col("doc_id").alias("d"))
    sets = sets.join(first, (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    return stage(sets.dropDuplicates(["doc_id", "cls"]).drop("doc_id", "sketch"), "jaccard-sets")


def _bounds(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds sizes and an upper bound of the overlap, from the bitmaps of both classes: all columns, na, nb, most."""
    wanted = pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "cls")
    some = stage(classes.select("cls", "n", "sketch").join(wanted, "cls"), "jaccard-sketches")
    side = lambda p: some.select(F.col("cls").alias(p), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"s{p}"))
    own = [f for f in pairs.schema.fields if f.name not in ("na", "nb", "most")]
    out = T.StructType([*own, *(T.StructField(c, T.LongType()) for c in ("na", "nb", "most"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = (batch.column(c).to_pylist() for c in ("sa", "na", "sb", "nb"))
            most = pa.array([most_common(*row) for row in zip(*parts)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out.names[:-1]), most], out.names)

    rows = pairs.select(*[f.name for f in own]).join(side("a"), "a").join(side("b"), "b")
    return rows.select(*out.names[:-1], "sa", "sb").mapInArrow(run, out)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the exact overlap to pairs of classes (a, b) with a table of sets (cls, n, tokens): (a, b, na, nb, o)."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap = [len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True))
                       for x, y in zip(batch.column("ta"), batch.column("tb"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(overlap, pa.int64())],
                ["a", "b", "na", "nb", "o"])

    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ta", "tb")
    return rows.mapInArrow(run, "a long, b long, na long, nb long, o long")


def _links(cfg: JaccardConfig, low: str | F.Column = "o") -> F.Column:
    """den * o >= num * (na + nb - o)."""
    o = F.col(low) if isinstance(low, str) else low
    return o * (cfg.den + cfg.num) >= (F.col("na") + F.col("nb")) * cfg.num


def _need(n: str, cfg: JaccardConfig) -> str:
    return f"(({cfg.num} * {n} + {cfg.den - 1}) div {cfg.den})"


def _meet(na: str, nb: str, cfg: JaccardConfig) -> str:
    both = cfg.num + cfg.den
    return f"(({cfg.num} * ({na} + {nb}) + {both - 1}) div {both})"


def _index(classes: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """(shingle, cls, n, rest, shallow, size): the prefixes of all classes, shingles that only one class has left out;
    rest is the number of the class's shingles from this one on, size that of classes that have it in their prefix."""
    shallow = F.expr(f"n - pos >= {_meet('n', 'n', cfg)}")
    listed = classes.select("cls", "n", F.posexplode("tokens").alias("pos", "shingle")).select(
        "shingle", "cls", F.col("n").cast("int").alias("n"), F.expr("cast(n - pos as int)").alias("rest"),
        shallow.alias("shallow"))
    shared = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # Spark takes exploded prefixes for as few rows as there are classes, and would broadcast them.
    return listed.join(shared.hint("merge"), "shingle")


def join_classes(docs: DataFrame, cfg: JaccardConfig) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets with their component, and the documents with their class.

    First table: (cls, n, root), root being the smallest class key of the component. Second: (doc_id, cls, n).
    """
    frequent = frequent_shingles(docs, cfg)
    described = stage(describe(docs, frequent, cfg), "jaccard-prefixes")
    members = described.select("doc_id", "cls", "n")
    # Equal sets have equal prefixes and bitmaps, so any document's stand for its class.
    classes = stage(described.where("cls is not null").groupBy("cls").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("tokens", "sketch")]),
        "jaccard-classes")
    index = stage(_index(classes, cfg), "jaccard-index")

    # A list is a shingle and a size block; a class stands in its own block and the next larger one. The width is a
    # little over the size ratio that linked sets can have, so that rounding cannot part them.
    width = float(np.log(cfg.den / cfg.num)) * 1.0001
    block = F.floor(F.log(F.col("n").cast("double")) / width)
    # Heads are the classes that meet the most others: among near copies of one text that is the text itself, while
    # a copy's own changes are met by no one.
    weight = index.groupBy("cls").agg(F.sum("size").alias("weight"))
    lists = index.join(weight, "cls").select(
        F.explode(F.array(block, block + 1)).alias("block"), "shingle", "cls", "shallow", "weight")
    heads = lists.groupBy("shingle", "block").agg(
        F.max(F.when(F.col("shallow"), F.struct("weight", "cls"))).getField("cls").alias("head"), F.count(F.lit(1)).alias("size"))
    heads = heads.where("size > 1 and head is not null").select("shingle", "block", "head")
    met = lists.join(heads, ["shingle", "block"]).where("cls != head").groupBy(
        F.col("cls").alias("a"), F.col("head").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    met = stage(met, "jaccard-met")

    # First pass: each class against the heads it meets most often, if it meets them as often as similar sets would.
    sizes = lambda p: classes.select(F.col("cls").alias(p), F.col("n").alias(f"n{p}"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("met"), "b"))
    tried = met.withColumn("at", best).where(F.col("at") <= cfg.heads).join(sizes("a"), "a").join(sizes("b"), "b")
    tried = tried.where(f"met > {_meet('na', 'nb', cfg)} - {_need('greatest(na, nb)', cfg)}").select("a", "b")
    tried = stage(_bounds(stage(tried, "jaccard-met-most"), classes).where(_links(cfg, "most")).select("a", "b"), "jaccard-tried")
    linked = stage(_overlaps(tried, _sets(docs, tried, classes, cfg)).where(_links(cfg)), "jaccard-first")
    known = _leaders(classes, linked)

    # Second pass: leaders whose lists still hold several components. Two sets that link share a shingle with so many of
    # either set from it on as they must have in common, and shallow in the smaller one. An entry holds the most that any
    # follower with the shingle allows, so pairs of groups without such a shingle are skipped as a whole, as by size:
    # copies of a text that are too far apart have their own changes first and do not all meet in the text's shingles.
    groups = stage(known.groupBy("leader").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("common")).alias("extra")), "jaccard-groups")
    seen = index.select("shingle", "cls", "rest", "shallow").join(known.select("cls", "n", "root", "leader"), "cls")
    mixed = seen.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("shingle")
    entries = stage(seen.join(mixed, "shingle").groupBy("shingle", "root", "leader").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.max("shallow").alias("shallow")),
        "jaccard-open")
    x, y = ({c: F.col(f"{p}.{c}") for c in entries.columns} for p in "xy")
    sized = (x["high"] * cfg.den >= y["low"] * cfg.num) & (y["high"] * cfg.den >= x["low"] * cfg.num)
    reached = F.least(x["rest"], y["rest"]) >= F.expr(_meet("x.low", "y.low", cfg))
    pairs = entries.alias("x").join(
        entries.alias("y"), (x["shingle"] == y["shingle"]) & (x["root"] < y["root"]) & sized & reached & (x["shallow"] | y["shallow"]))
    pairs = pairs.select(x["leader"].alias("a"), y["leader"].alias("b")).distinct()
    pairs = stage(pairs, "jaccard-pairs")
    of = lambda p: groups.select(F.col("leader").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("low", "extra")])
    pairs = _bounds(stage(pairs.join(of("a"), "a").join(of("b"), "b"), "jaccard-sized"), classes)
    # Pairs that can neither link themselves nor lead followers that do are decided.
    near = lambda o: f"({o} + extra_a + extra_b) * {cfg.num + cfg.den} >= {cfg.num} * (low_a + low_b)"
    bounded = stage(pairs.where(_links(cfg, "most") | F.expr(near("most"))).drop("na", "nb", "most"), "jaccard-bounded")
    second = stage(_overlaps(bounded, _sets(docs, bounded, classes, cfg)), "jaccard-second")
    close = second.where(_links(cfg)).select("a", "b")
    known = _leaders(classes, linked, close)

    # Third pass: followers of leaders that did not link, where they share a shingle in time to link. A follower's overlap
    # differs from its leader's by what the two have apart at most; that decides most pairs, and the rest are compared. A
    # leader may follow another, so a group of one need not be the leader itself; where it is, nothing is apart and the
    # bound passes over it.
    apart = bounded.select("a", "b", *[f"{c}_{p}" for p in "ab" for c in ("low", "extra")]).join(
        second.where(~_links(cfg)).select("a", "b", "o"), ["a", "b"])
    apart = stage(apart.where(near("o")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o"), "jaccard-apart")
    side = ("leader", "cls", "n", "leader_n", "common")
    led = stage(known.join(apart.select(F.explode(F.array("a", "b")).alias("leader")).distinct(), "leader"), "jaccard-followers")
    led_lists = stage(index.select("shingle", "cls", "rest", "shallow").join(led.select(*side, "root"), "cls"), "jaccard-led")
    x, y = ({c: F.col(f"{p}.{c}") for c in led_lists.columns} for p in "xy")
    smaller = F.struct(x["n"], x["cls"]) < F.struct(y["n"], y["cls"])
    sized = x["n"] * cfg.den >= y["n"] * cfg.num
    reached = F.least(x["rest"], y["rest"]) >= F.expr(_meet("x.n", "y.n", cfg))
    found = led_lists.where("shallow").alias("x").join(
        led_lists.alias("y"), (x["shingle"] == y["shingle"]) & (x["root"] != y["root"]) & smaller & sized & reached)
    # A pair is known by its two classes alone until it is distinct: with whole sides as keys, made of structs, the method
    # that Spark generates took more than 300 MB of each executor to compile, which it kept.
    found = stage(found.select(x["cls"].alias("cx"), y["cls"].alias("cy")).distinct(), "jaccard-found")
    of = lambda p: led.select(*[F.col(c).alias(f"{c}_{p}") for c in side])
    found = found.join(of("x"), F.col("cx") == F.col("cls_x")).join(of("y"), F.col("cy") == F.col("cls_y"))
    both = apart.unionAll(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "o")).select(
        F.col("a").alias("leader_x"), F.col("b").alias("leader_y"), "o")
    open_pairs = found.join(both, ["leader_x", "leader_y"]).select(
        F.col("cls_x").alias("a"), F.col("cls_y").alias("b"), F.col("n_x").alias("na"), F.col("n_y").alias("nb"),
        F.expr("o + n_x - common_x + n_y - common_y").alias("most"),
        F.expr("o - (leader_n_x - common_x) - (leader_n_y - common_y)").alias("least"))
    open_pairs = open_pairs.withColumn("most", F.least("most", "na", "nb")).where(_links(cfg, "most"))
    open_pairs = stage(open_pairs, "jaccard-third")
    late, unsure = open_pairs.where(_links(cfg, "least")).select("a", "b"), open_pairs.where(~_links(cfg, "least"))
    unsure = stage(_bounds(unsure.select("a", "b"), classes).where(_links(cfg, "most")).select("a", "b"), "jaccard-unsure")
    if not unsure.isEmpty():
        late = late.unionAll(_overlaps(unsure, _sets(docs, unsure, classes, cfg)).where(_links(cfg)).select("a", "b"))
    late = stage(late, "jaccard-late")
    if not late.isEmpty():
        known = _leaders(classes, linked, close.unionAll(late))
    return known.select("cls", "n", "root"), members


def _leaders(classes: DataFrame, linked: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(cls, n, root, leader, leader_n, common): component and leader of each class.

    The leader is the head that a class overlaps most among those it links to, itself where there is none.
    """
    edges = linked.select("a", "b")
    roots = components(edges if more is None else edges.unionAll(more), "a", "b", "jaccard").withColumnRenamed("node", "cls")
    lead = linked.groupBy("a").agg(F.max(F.struct("o", "b", "nb")).alias("m")).select(
        F.col("a").alias("cls"), F.col("m.b").alias("leader"), F.col("m.nb").alias("leader_n"), F.col("m.o").alias("common"))
    known = classes.select("cls", "n").join(roots, "cls", "left").join(lead, "cls", "left").select(
        "cls", "n", F.coalesce("component", "cls").alias("root"), F.coalesce("leader", "cls").alias("leader"),
        F.coalesce("leader_n", "n").alias("leader_n"), F.coalesce("common", "n").alias("common"))
    return stage(known, "jaccard-known")


def component_ids(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links, the document itself included. Documents with equal sets
    are linked. Null texts and texts without words have no shingles, link with nothing and stand alone. Rows with a
    null doc_id take part; they lend no id. Repeated rows are kept. An empty table gives no rows.
    """
    classes, members = join_classes(docs, cfg)
    lowest = members.groupBy("cls").agg(F.min("doc_id").alias("first")).join(classes, "cls")
    lowest = lowest.groupBy("root").agg(F.min("first").alias("lowest"))
    rooted = classes.select("cls", "root").join(lowest, "root").select("cls", "lowest")
    return members.join(rooted, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """The documents, all columns, without those that are linked to one kept: the smallest doc_id of a group stays.

    Documents without words are in no group. Rows equal in doc_id and text are one document and stay once; a null id
    comes after all others.
    """
    key = F.xxhash64("doc_id", "text")
    groups = component_ids(docs.select(key.alias("doc_id"), "text"), cfg).select(
        F.col("doc_id").alias("row_key"), F.col("component_id").alias("root"))
    ids = docs.select(key.alias("row_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1)).alias("id")).distinct()
    first = groups.distinct().join(ids, "row_key").groupBy("root").agg(F.min(F.struct("id", "row_key")).alias("m"))
    kept = stage(first.select(F.col("m.row_key").alias("__row_key")), "jaccard-kept")
    return docs.withColumn("__row_key", key).join(kept, "__row_key", "left_semi").dropDuplicates(["__row_key"]).drop("__row_key")
