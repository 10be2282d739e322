"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items.

The index is small and goes to all tasks; passages are searched where they are read. Block-max WAND finds every item
whose score reaches the threshold, and an overlap of word shingles with the question and the answer decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class LeakConfig:
    #: Words of a passage and from one passage to the next; an item's parts are no longer than their difference.
    passage: int = 128
    stride: int = 64
    #: BM25 parameters, and the least score in parts of what the item scores against itself.
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5
    #: Words of a shingle, and the least share of the question's and of the answer's shingles that must be found.
    shingle: int = 5
    overlap: float = 0.8
    #: Entries of a posting block at least, and blocks at most; the table of block maxima has a row for each term.
    block: int = 2
    blocks: int = 128
    #: Bytes of item text that one index holds; more items are searched in several passes over the corpus.
    index_bytes: int = 2 << 20


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence, and those of the last sentence; a single sentence is all answer."""
    sentences = [w for w in map(words_of, _SENTENCE.findall(text)) if w]
    return [w for s in sentences[:-1] for w in s], sentences[-1] if sentences else []


def shingle_set(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Shingles of `size` words, of fewer where there are not so many."""
    size = min(size, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if size else set()


def found_share(wanted: set[tuple[str, ...]], words: list[str]) -> float:
    """Share of the wanted shingles (all of one size) that the words hold; 1 where nothing is wanted."""
    if not wanted:
        return 1.0
    size = len(next(iter(wanted)))
    return len(wanted & shingle_set(words, size)) / len(wanted) if len(words) >= size else 0.0


@dataclass
class ItemIndex:
    """Postings of item parts by term, with the largest weight of each list and, as a table, of each block."""

    cfg: LeakConfig
    block: int = 1
    terms: dict[str, int] = field(default_factory=dict)
    ids: list[list[int]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    highest: list[float] = field(default_factory=list)
    #: Largest weight of a term (row) in a block (column); the last row, of terms that no item has, is zero.
    table: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    entries: list[int] = field(default_factory=list)  # entry -> item
    items: list[tuple[int, set, set, int]] = field(default_factory=list)  # id, question, answer, words

    def open_blocks(self, passages: np.ndarray, terms: np.ndarray) -> list[tuple[int, int]]:
        """(passage, block) pairs whose block maxima together reach the threshold.

        `passages` and `terms` name the words of passages; a term counts once in a passage.
        """
        key = np.unique(passages * len(self.table) + (terms + 1))
        passage, row = np.divmod(key, len(self.table))
        first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        bound = np.add.reduceat(self.table[row - 1], first, axis=0)
        at, block = np.nonzero(bound >= self.cfg.threshold - 1e-4)
        return list(zip(passage[first][at].tolist(), block.tolist()))

    def search(self, terms: list[int], block: int) -> dict[int, float]:
        """Entries of a block whose score for these distinct terms reaches the threshold, by weak-and pivots."""
        goal = self.cfg.threshold - 1e-9
        low, stop = block * self.block, (block + 1) * self.block
        cursors = []
        for t in terms:
            at = bisect_left(self.ids[t], low)
            if at < len(self.ids[t]) and self.ids[t][at] < stop:
                cursors.append([self.ids[t][at], at, t])
        found: dict[int, float] = {}
        while cursors:
            cursors.sort()
            reach, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                reach += self.table[t, block]
                if reach >= goal - 1e-4:
                    pivot = i
                    break
            if pivot < 0:
                break
            entry = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == entry:
                pivot += 1
            if cursors[0][0] == entry:
                behind, move = cursors[:pivot + 1], entry + 1
                score = sum(self.weights[t][at] for _, at, t in behind)
                if score >= goal:
                    found[entry] = score
            else:  # entries before the pivot cannot reach the goal
                behind, move = [c for c in cursors[:pivot] if c[0] < entry], entry
            for c in behind:
                at = bisect_left(self.ids[c[2]], move, c[1])
                c[0], c[1] = (self.ids[c[2]][at], at) if at < len(self.ids[c[2]]) else (stop, at)
            cursors = [c for c in cursors if c[0] < stop]
        return found


def build_index(items: list[tuple[int, str]], frequency: dict[str, int], entries: int, mean: float, cfg: LeakConfig) -> ItemIndex:
    """An index of these items, with the number, mean length and term frequencies of the parts of all items."""
    index = ItemIndex(cfg)
    parts: list[tuple[int, dict[str, float]]] = []
    for item_id, text in items:
        question, answer = question_answer(text)
        index.items.append((item_id, shingle_set(question, cfg.shingle), shingle_set(answer, cfg.shingle), len(question) + len(answer)))
        for part in item_parts(text, cfg):
            count = Counter(part)
            norm = cfg.k1 * (1 - cfg.b + cfg.b * len(part) / mean)
            weight = {t: float(np.log(1 + (entries - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (cfg.k1 + 1) / (n + norm))
                      for t, n in count.items()}
            own = sum(weight.values())
            parts.append((len(index.items) - 1, {t: w / own for t, w in weight.items()}))
    # Entries with the same commonest term, mostly of one language, and of like length share blocks: their weights
    # are alike, so that the block maxima are close to the weights.
    parts.sort(key=lambda p: (max(p[1], key=lambda t: (frequency[t], t)), len(p[1])))
    index.block = max(cfg.block, -(-len(parts) // cfg.blocks))
    index.terms = {t: i for i, t in enumerate(sorted({t for _, weight in parts for t in weight}))}
    index.table = np.zeros((len(index.terms) + 1, -(-len(parts) // index.block)), np.float32)
    index.ids, index.weights = [[] for _ in index.terms], [[] for _ in index.terms]
    for entry, (item, weight) in enumerate(parts):
        index.entries.append(item)
        for t, w in weight.items():
            n = index.terms[t]
            index.ids[n].append(entry)
            index.weights[n].append(w)
            index.table[n, entry // index.block] = max(index.table[n, entry // index.block], w)
    index.highest = index.table.max(axis=1, initial=0.0)[:-1].tolist()
    return index


def item_parts(text: str, cfg: LeakConfig) -> list[list[str]]:
    """The words of an item in parts that fit every alignment of passages."""
    words = words_of(text)
    longest = cfg.passage - cfg.stride
    return [words[i:i + longest] for i in range(0, len(words), longest)]


def _search_texts(shared, cfg: LeakConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        highest = np.array([*index.highest, 0.0])
        number = index.terms.get
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py() or "")
                if not words:
                    continue
                terms = np.array([number(w, -1) for w in words])
                total = np.concatenate(([0.0], np.cumsum(highest[terms])))
                starts = np.arange(0, max(1, len(words) - cfg.stride), cfg.stride)
                stops = np.minimum(starts + cfg.passage, len(words))
                able = np.flatnonzero(total[stops] - total[starts] >= cfg.threshold - 1e-4)
                if not len(able):
                    continue
                spans = stops[able] - starts[able]
                place = np.arange(spans.sum()) + np.repeat(starts[able] - np.cumsum(spans) + spans, spans)
                for passage, block in index.open_blocks(np.repeat(able, spans), terms[place]):
                    start = int(starts[passage])
                    distinct = set(terms[start:start + cfg.passage].tolist()) - {-1}
                    for entry, score in index.search(list(distinct), block).items():
                        item_id, question, answer, length = index.items[index.entries[entry]]
                        region = words[max(0, start - length):start + cfg.passage + length]
                        shares = found_share(question, region), found_share(answer, region)
                        if min(shares) >= cfg.overlap:
                            for column, value in zip(out, (doc, item_id, score, *shares, start)):
                                column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             ["doc_id", "item_id", "score", "question", "answer", "word"])
    return run


def _parts_of_items(cfg: LeakConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [p for t in batch.column(0).to_pylist() for p in item_parts(t, cfg)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(p) for p in parts], pa.int64()), pa.array([sorted(set(p)) for p in parts], pa.list_(pa.string()))],
                ["length", "terms"])
    return run


def find_leaks(docs: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """Benchmark items found in documents: doc_id, item_id, score, question, answer, word.

    One row per document row and item: the best passage's score in parts of the item's own, the shares of the question
    and of the answer found, and the word where the passage starts. The question is all but the last sentence of an
    item. Null or empty texts hold and give nothing; equal item rows count once, items that share an id are searched
    each and reported together; equal document rows with one id are reported once; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = known.where("text is not null").distinct()
    parts = known.select("text").mapInArrow(_parts_of_items(cfg), "length long, terms array<string>")
    entries, mean = parts.agg(F.count(F.lit(1)), F.avg("length")).first()
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // cfg.index_bytes))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequency = parts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    found = None
    for turn in range(passes if entries else 0):
        chosen = known.where(F.expr(f"pmod(xxhash64(item_id, text), {passes}) = {turn}"))
        # About cfg.index_bytes of text, and the frequencies of the terms in it.
        listed = [(r["item_id"], r["text"]) for r in chosen.orderBy("item_id", "text").collect()]
        terms = chosen.select("text").mapInArrow(_parts_of_items(cfg), "length long, terms array<string>")
        terms = terms.select(F.explode("terms").alias("term")).distinct().join(frequency, "term")
        counts = {r["term"]: r["n"] for r in terms.collect()}
        shared = spark.sparkContext.broadcast(build_index(listed, counts, entries, mean, cfg))
        hits = texts.mapInArrow(
            _search_texts(shared, cfg), "doc_id long, item_id long, score double, question double, answer double, word long")
        found = hits if found is None else found.unionAll(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, question double, answer double, word long")
    best = F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("word")).alias("back"), "question", "answer")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.score", "b.question", "b.answer", (-F.col("b.back")).alias("word"))
