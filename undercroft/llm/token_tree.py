"""Token counts that follow edits: a segment tree per document over pieces cut where no token can cross.

A piece ends before a single space between two other characters; there the splitting pattern of the tokenizer always
parts, whatever stands further away, so counts of pieces add up. An edit re-encodes the pieces it touches and those
whose ends it stands next to, and renews the sums above them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.llm.packing import encode
from undercroft.session import stage

#: Characters of a piece, about.
PIECE = 256
#: A leaf that grew to so many times a piece has its document's tree built anew.
GROWN = 16

TREE = "row_key long, chars array<long>, tokens array<long>"


def cuts(text: str, piece: int = PIECE) -> list[int]:
    """Ends of the pieces of a text, the last being its length; a piece is at least `piece` long."""
    ends, at = [], 0
    while len(text) - at > piece:
        end = text.find(" ", at + piece)
        while end > 0 and (end + 1 >= len(text) or text[end - 1].isspace() or text[end + 1].isspace()):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        ends.append(end)
        at = end
    return [*ends, len(text)]


@dataclass
class TokenTree:
    """Sums of characters and tokens: node 1 is the root, the children of i are 2i and 2i + 1, leaves fill the half."""

    chars: np.ndarray
    tokens: np.ndarray
    encoded: int = 0
    renewed: int = 0

    @staticmethod
    def build(text: str, path: str) -> TokenTree:
        ends = cuts(text)
        size = 1
        while size < len(ends):
            size *= 2
        chars, tokens = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
        start = 0
        for i, end in enumerate(ends):
            chars[size + i], tokens[size + i] = end - start, len(encode(text[start:end], path))
            start = end
        for i in range(size - 1, 0, -1):
            chars[i], tokens[i] = chars[2 * i] + chars[2 * i + 1], tokens[2 * i] + tokens[2 * i + 1]
        return TokenTree(chars, tokens, len(text), 2 * size - 1)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the character `at`; the last leaf with text for the end of the text."""
        at = min(at, int(self.chars[1]) - 1)
        node, start = 1, 0
        if at < 0:
            return len(self.chars) // 2, 0
        while node < len(self.chars) // 2:
            node *= 2
            if start + self.chars[node] <= at:
                start += int(self.chars[node])
                node += 1
        return node, start

    def edit(self, text: str, start: int, end: int, put: str, path: str) -> str:
        """The text with characters start..end replaced by `put`; sums follow. Places beyond the text are its end."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        new = text[:start] + put + text[end:]
        # The boundary before a space holds as long as the characters on both sides and the one after stay.
        first, begin = self.leaf(max(0, start - 2))
        last, _ = self.leaf(min(len(text), end + 2))
        stop = begin + int(self.chars[first:last + 1].sum())
        region = new[begin:stop + len(new) - len(text)]
        if len(region) > GROWN * PIECE * (last - first + 1):
            fresh = TokenTree.build(new, path)
            self.chars, self.tokens = fresh.chars, fresh.tokens
            self.encoded += fresh.encoded
            self.renewed += fresh.renewed
            return new
        # The leaves of the region take its new pieces, the first ones empty if there are fewer, the last the rest.
        ends = cuts(region)
        slots = last - first + 1
        parts = [region[a:b] for a, b in zip([0, *ends], ends)]
        if len(parts) > slots:
            parts = parts[:slots - 1] + ["".join(parts[slots - 1:])]
        parts += [""] * (slots - len(parts))
        for i, part in enumerate(parts):
            self.chars[first + i], self.tokens[first + i] = len(part), len(encode(part, path)) if part else 0
            self.encoded += len(part)
        touched = range(first, last + 1)
        self.renewed += len(touched)
        while touched[0] > 1:
            touched = range(touched[0] // 2, touched[-1] // 2 + 1)
            for i in touched:
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.renewed += len(touched)
        return new


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def build_trees(docs: DataFrame, path: str) -> DataFrame:
    """(row_key, chars, tokens): the tree of every document; equal rows (id and text) share one key and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [TokenTree.build(t.as_py(), path) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.chars for t in trees], pa.list_(pa.int64())),
                 pa.array([t.tokens for t in trees], pa.list_(pa.int64()))], ["row_key", "chars", "tokens"])

    return _rows(docs).select("row_key", "text").mapInArrow(run, TREE)


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """Counts after edits: doc_id, tokens_before, tokens_after, chars, chars_encoded, nodes_renewed, row_key, text.

    `trees` are those of `docs`; `edits` has row_key, seq, start, stop and put: in the order of seq, characters
    start..stop of the text so far become `put` (null counts as empty). Documents without edits keep their count and
    encode nothing. Null texts count as empty; edits of unknown documents do nothing.
    """
    step = F.struct("seq", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.coalesce("stop", F.lit(0)).cast("long").alias("stop"),
                    F.coalesce("put", F.lit("")).alias("put"))
    feed = edits.groupBy("row_key").agg(F.sort_array(F.collect_list(step)).alias("edits"))
    state = trees.dropDuplicates(["row_key"]).join(feed, "row_key", "left")
    rows = _rows(docs).join(state, "row_key").select("doc_id", "row_key", "text", "chars", "tokens", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text, chars, tokens, feed in zip(batch.column(2), batch.column(3), batch.column(4), batch.column(5).to_pylist()):
                tree = TokenTree(chars.values.to_numpy().copy(), tokens.values.to_numpy().copy())
                now, before = text.as_py(), tree.total
                for e in feed or ():
                    now = tree.edit(now, e["start"], e["stop"], e["put"], path)
                for column, value in zip(out, (before, tree.total, len(now), tree.encoded, tree.renewed, now)):
                    column.append(value)
            kinds = (*[pa.int64()] * 5, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *[pa.array(c, k) for c, k in zip(out, kinds)]],
                ["doc_id", "row_key", "tokens_before", "tokens_after", "chars", "chars_encoded", "nodes_renewed", "text"])

    return rows.mapInArrow(run, "doc_id long, row_key long, tokens_before long, tokens_after long, chars long, "
                                "chars_encoded long, nodes_renewed long, text string")


def revisions(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A feed of edits made from the tables: in every document a stretch of up to 40 characters, at a place given by a
    hash, becomes the text of a benchmark item, and the document's source is added at the end."""
    n = F.length("text")
    at = F.pmod(F.xxhash64("row_key"), n + 1)
    rows = _rows(docs).select("row_key", at.alias("start"), n.alias("n"), F.pmod(F.hash("row_key"), F.lit(41)).alias("wide"))
    rows = rows.distinct()
    numbered = items.where("text is not null").select(F.col("text").alias("put"), F.col("item_id").cast("long").alias("item_id"))
    count = numbered.agg(F.coalesce(F.max("item_id"), F.lit(0))).first()[0] + 1
    changed = rows.withColumn("item_id", F.pmod(F.xxhash64("row_key", F.lit(1)), F.lit(count)))
    changed = changed.join(numbered.groupBy("item_id").agg(F.min("put").alias("put")), "item_id", "left")
    first = changed.select("row_key", F.lit(1).alias("seq"), "start", (F.col("start") + F.col("wide")).alias("stop"), "put")
    last = rows.select("row_key", F.lit(2).alias("seq"), F.lit(2 ** 40).alias("start"), F.lit(2 ** 40).alias("stop"),
                       F.concat(F.lit("\nsource "), F.hex("n")).alias("put"))
    return first.unionAll(last)


def count_revised(docs: DataFrame, items: DataFrame, path: str) -> DataFrame:
    """Trees of all documents, kept as a table, then the revisions applied to them."""
    trees = stage(build_trees(docs, path), "token-trees")
    return apply_edits(docs, trees, stage(revisions(docs, items), "token-edits"), path)
