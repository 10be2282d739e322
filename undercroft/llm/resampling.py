"""Target-distribution importance resampling with an Aho-Corasick word dictionary.

Distinct words, each between two delimiters, are the dictionary's entries; an entry carries the CRC of the word and its
length. One scan of a text emits the payloads in order, and payloads of neighbours are composed to the CRCs of longer
runs of words, so no run is ever spelled out. The CRCs give the buckets that are counted and scored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.session import stage

_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]+")
#: Words that a task composes at a time, and bytes of short texts that it scans together.
SLICE = 200_000
STRETCH = 1_000_000
#: Distinct words that a task counts or remembers at a time.
MEMO = 200_000
#: Rows of a ranking task, about.
RANK_ROWS = 250_000


@dataclass(frozen=True)
class ResampleConfig:
    buckets: int = 10_000
    #: Longest run of words that is a feature.
    words: int = 3
    #: Entries of the dictionary at most, the most frequent words; the others' payloads are computed where they stand.
    dictionary: int = 65_536
    #: Texts with fewer words are not drawn.
    least_words: int = 20
    #: Texts drawn of a hundred.
    percent: int = 5
    seed: int = 42


def normal(text: str | None) -> bytes:
    """Words as UTF-8 in ASCII lower case with one delimiter between neighbours."""
    return _BREAK.sub(b"\n", (text or "").encode().lower()).strip(b"\n")


@lru_cache(maxsize=1)
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables that push a CRC past 0 to 64 bytes, and past 2**k bytes."""
    def table(step) -> np.ndarray:
        return np.array([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)], dtype=np.uint32)

    byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    one = table(lambda x: (x >> np.uint32(8)) ^ byte[x & np.uint32(255)])
    short = [table(lambda x: x)]
    for _ in range(64):
        short.append(_apply(one, short[-1]))
    powers = [one]
    for _ in range(39):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.array(short), np.array(powers)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    mask = np.uint32(255)
    return (table[0][crc & mask] ^ table[1][crc >> np.uint32(8) & mask]
            ^ table[2][crc >> np.uint32(16) & mask] ^ table[3][crc >> np.uint32(24)])


def push(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs as they enter the CRC of a longer text, `size` bytes further on."""
    short, powers = _shifts()
    mask = np.uint32(255)
    near = np.where(size <= 64, size, 0)
    out = (short[near, 0, crc & mask] ^ short[near, 1, crc >> np.uint32(8) & mask]
           ^ short[near, 2, crc >> np.uint32(16) & mask] ^ short[near, 3, crc >> np.uint32(24)])
    far = np.flatnonzero(size > 64)
    if len(far):
        moved, left = out[far], size[far]
        for k in range(int(left.max()).bit_length()):
            use = (left >> k & 1).astype(bool)
            moved[use] = _apply(powers[k], moved[use])
        out[far] = moved
    return out


class WordDictionary:
    """The automaton over delimiter-bounded words, and their payloads: CRC, CRC behind a space, length in bytes."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            self.automaton.add_word("\n" + word.decode("latin-1") + "\n", i)
        if words:
            self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(w) for w in words], dtype=np.uint32)
        self.spaced = np.array([zlib.crc32(b" " + w) for w in words], dtype=np.uint32)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.memo: dict[str, tuple[int, int, int]] = {}

    def _other(self, text: str) -> list[tuple[int, int, int]]:
        """Payloads of the words of a stretch that no entry covers."""
        found = []
        for word in text.split("\n"):
            known = self.memo.get(word)
            if known is None:
                if len(self.memo) > MEMO:
                    self.memo.clear()
                raw = word.encode("latin-1")
                known = self.memo[word] = (zlib.crc32(raw), zlib.crc32(b" " + raw), len(raw))
            found.append(known)
        return found

    def scan(self, data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """Payloads of all words of a normal text in order, in slices: (crc, spaced, size, place of the word's end).

        An entry's match begins at the delimiter where the one before ended; where it does not, words that are no
        entries stand between, and theirs are put in their place.
        """
        if not data:
            return
        text = "\n" + data.decode("latin-1") + "\n"
        matches = self.automaton.iter(text) if len(self.size) else iter(())
        reached, last = 0, len(text) - 1
        while reached < last:
            found = np.fromiter(chain.from_iterable(islice(matches, SLICE)), np.int64).reshape(-1, 2)
            ends, ids = found[:, 0], found[:, 1]
            whole = len(ends) < SLICE
            starts = ends - self.size[ids] - 1
            due = np.append(reached, ends)
            if whole:
                starts = np.append(starts, last)
            gaps = np.flatnonzero(starts != due[:len(starts)])
            columns = [self.crc[ids], self.spaced[ids], self.size[ids], ends]
            reached = last if whole else int(ends[-1])
            if len(gaps):
                others = [self._other(text[d + 1:s]) for d, s in zip(due[gaps].tolist(), starts[gaps].tolist())]
                counts = np.fromiter(map(len, others), np.int64, len(others))
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(others)), np.int64).reshape(-1, 3)
                # Ends follow from the sizes: words and single delimiters fill a gap.
                behind = np.cumsum(flat[:, 2] + 1)
                before = np.append(0, behind)[np.cumsum(counts) - counts]
                place = np.repeat(due[gaps] - before, counts) + behind
                at = np.repeat(gaps, counts)
                columns = [np.insert(c, at, x.astype(c.dtype)) for c, x in zip(columns, [*flat.T, place])]
            for i in range(0, len(columns[0]), SLICE):
                yield tuple(c[i:i + SLICE] for c in columns)


_built: dict[str, WordDictionary] = {}


def _dictionary(shared) -> WordDictionary:
    """The automaton of a broadcast (name, words), built once in a worker process."""
    name, words = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = WordDictionary(words)
    return _built[name]


def compose(crc: np.ndarray, spaced: np.ndarray, size: np.ndarray, text: np.ndarray, words: int,
            ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: (position of the run's last word, CRC of the run); runs stay inside a text."""
    at, run = np.arange(len(crc)), crc
    yield at, run
    for n in range(1, words):
        inside = text[n:] == text[:-n] if n < len(text) else np.zeros(0, bool)
        # `run` holds runs of n words by their first position; those that one more word of the same text follows grow.
        run = run[:len(inside)]
        run = push(run, size[n:] + 1) ^ spaced[n:]
        yield at[n:][inside], run[inside]


def _groups(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Neighbouring texts joined to stretches worth a scan: (normal text, numbers of the texts, where each ends)."""
    held: list[bytes] = []
    numbers: list[int] = []
    size = 0
    for number, text in enumerate(texts):
        data = normal(text.as_py())
        if data:
            held.append(data)
            numbers.append(number)
            size += len(data) + 1
        if size >= STRETCH:
            yield b"\n".join(held), np.array(numbers), np.cumsum([len(d) + 1 for d in held])
            held, numbers, size = [], [], 0
    if held:
        yield b"\n".join(held), np.array(numbers), np.cumsum([len(d) + 1 for d in held])


def _slices(texts: pa.Array, words: WordDictionary, longest: int) -> Iterator[tuple]:
    """Payloads of a batch in bounded slices: (crc, spaced, size, text number, own).

    A text longer than a slice goes on in the next one, behind its last words again, which are not its own there.
    """
    for data, numbers, ends in _groups(texts):
        tail = None
        for crc, spaced, size, place in words.scan(data):
            text = numbers[np.searchsorted(ends, place, side="left")]
            columns = (crc, spaced, size, text)
            own = np.ones(len(crc), bool)
            if tail is not None:
                columns = tuple(np.concatenate(c) for c in zip(tail, columns))
                own = np.concatenate([np.zeros(len(tail[0]), bool), own])
            yield *columns, own
            tail = tuple(c[-(longest - 1):] for c in columns) if longest > 1 else None


def frequent_words(texts: DataFrame, limit: int) -> list[bytes]:
    """At most `limit` words, those that stand in the texts most often.

    Tasks count first. How many words are how frequent is told by a histogram of a few hundred rows, which gives the
    least frequency that keeps the list inside its bound.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def drain():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return rows
        for batch in batches:
            for text in batch.column(0):
                data = normal(text.as_py())
                if data:
                    counts.update(data.split(b"\n"))
                if len(counts) > MEMO:
                    yield drain()
        yield drain()

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    counted = stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    # Frequencies fall into 16 classes between one power of two and the next.
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for row in sizes:
        total += row["words"]
        if total > limit:
            break
        least = row["level"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in counted.where(level >= least).select("word").collect())


def bucket_counts(texts: DataFrame, shared, cfg: ResampleConfig) -> np.ndarray:
    """Features of all texts by bucket; the tasks add up their own, so a bucket meets one row of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.buckets, np.int64)
        words = _dictionary(shared)
        for batch in batches:
            for crc, spaced, size, text, own in _slices(batch.column(0), words, cfg.words):
                for last, run_crc in compose(crc, spaced, size, text, cfg.words):
                    total += np.bincount(run_crc[own[last]] % cfg.buckets, minlength=cfg.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(cfg.buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most cfg.buckets rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a text's weight: thousandths of the log ratio, rounded down."""
    m, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m))))
        for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, shared, gain: np.ndarray, cfg: ResampleConfig) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _dictionary(shared)
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for crc, spaced, size, text, own in _slices(batch.column(1), words, cfg.words):
                n_words += np.bincount(text[own], minlength=batch.num_rows)
                for last, run_crc in compose(crc, spaced, size, text, cfg.words):
                    mine = own[last]
                    of, gain_of = text[last[mine]], gain[run_crc[mine] % cfg.buckets]
                    n_features += np.bincount(of, minlength=batch.num_rows)
                    # Sums of whole numbers, exact in doubles below 2**53.
                    weight += np.bincount(of, weights=gain_of, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (n_words, n_features, weight))],
                ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """Adds score and rank: the weight with Gumbel noise keyed by the id, and the order among the texts drawn.

    Rows are dealt by ranges of the score and numbered inside their range, so no task holds all of them.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
                                  256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    able = F.col("n_words") >= cfg.least_words
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("able", able)
    scored = stage(scored, "resample-scored")
    n, able_n = scored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("able").cast("long")), F.lit(0))).first()
    drawn = able_n * cfg.percent // 100
    order = [F.desc("able"), F.desc("score"), F.col("doc_id").asc_nulls_last()]
    dealt = scored.repartitionByRange(max(8, -(-n // RANK_ROWS)), *order).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt, "resample-dealt")
    before, offsets = 0, []
    for row in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        offsets.append((row["part"], before))
        before += row["n"]
    # One row for each range.
    offsets = weighed.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    ranked = dealt.join(F.broadcast(offsets), "part").withColumn("place", place.cast("long"))
    return ranked.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("able") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, cfg: ResampleConfig = ResampleConfig()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; `target` holds the texts to come close to.

    Reads doc_id and text of `docs` and text of `target`. Null and empty texts have no features and weight 0. Repeated
    rows count and are ranked each; a null id is hashed as an empty one and comes last among ties. Without target texts
    all gains follow from the documents alone; an empty table of documents gives no rows.
    """
    words = frequent_words(docs, cfg.dictionary)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, words))  # bounded by cfg.dictionary
    gain = gains(bucket_counts(docs, shared, cfg), bucket_counts(target, shared, cfg))
    return draw(weigh(docs, shared, gain, cfg), cfg)
