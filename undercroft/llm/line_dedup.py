"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised, equal ones are one line, and each gets a 64-bit SimHash of its distinct words. Lines that
agree in two of four blocks of the SimHash meet (lines that differ in two bits at most always do), edit similarity
decides, and of each connected group of lines one occurrence is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undercroft.llm.common import components
from undercroft.session import stage

#: One in each of the four 16-bit lanes of a long.
_LANES = 0x0001000100010001
#: Remainders that stand for keys in a first filter: so many rows are broadcast at most, whatever the corpus holds.
_REMAINDERS = 1 << 22
#: Characters of the pieces by which two lines are compared before they are as a whole.
_PIECES = (64, 256, 1024)
#: Words that a lane can count and compare without touching the next lane.
_CHUNK = 16_000


@dataclass(frozen=True)
class LineConfig:
    #: Least edit similarity: 1 - distance / length of the longer line, in normalised characters.
    similarity: float = 0.8


def spaced(text: Column) -> Column:
    """Lower case; every run of characters that are no letters, digits or newlines is one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def normalised(line: Column) -> Column:
    """Lower case; every run of characters that are no letters or digits is one space; none at the ends."""
    return F.trim(spaced(line))


def _simhash(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SimHash of the column h over groups of at most _CHUNK rows.

    Sixteen sums count all 64 bits, four in each: sum j holds bits j, j + 16, j + 32 and j + 48 in lanes of 16 bits.
    """
    sums = [F.sum(F.expr(f"shiftrightunsigned(h, {j}) & {_LANES}L")).alias(f"s{j}") for j in range(16)]
    counted = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), *sums)
    # Adding this much lifts a lane over 2^14 just when the bit is set in more than half of the words.
    lift = f"(16383 - words div 2) * {_LANES}L"
    bits = [f"shiftleft(shiftrightunsigned(s{j} + {lift}, 14) & {_LANES}L, {j})" for j in range(16)]
    return counted.select(*keys, F.expr(" | ".join(bits)).alias("simhash"))


def _rows(docs: DataFrame) -> DataFrame:
    """(row_key, doc, text) of every document, null texts empty.

    row_key stands for a document: a hash of its id and text, so equal rows are one document. A null id sorts last.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.xxhash64("doc_id", text).alias("row_key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2 ** 63 - 1)).alias("doc"), text.alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(row_key, doc, line, text): the lines of every document, parted at newlines."""
    return _rows(docs).select("row_key", "doc", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _normal_lines(docs: DataFrame) -> DataFrame:
    # A text is normalised as a whole, before it is parted: once, however often its lines are used.
    both = F.arrays_zip(F.split("text", "\n").alias("text"), F.split(spaced(F.col("text")), "\n").alias("spaced"))
    rows = _rows(docs).select("row_key", "doc", F.posexplode(both).alias("line", "both"))
    rows = rows.where("both.spaced not in ('', ' ')").select(
        "row_key", "doc", "line", F.trim("both.spaced").alias("normal"), F.xxhash64("both.text").alias("raw_id"))
    return rows.select("row_key", "doc", "line", "normal", F.xxhash64("normal").alias("line_id"), "raw_id")


def _occurrences(docs: DataFrame) -> DataFrame:
    """(row_key, doc, line, line_id, raw_id, simhash) of every line that has a letter or digit."""
    keys = ("row_key", "doc", "line", "line_id", "raw_id")
    # Distinct words, lest a few common ones make all lines of a language alike.
    words = F.array_distinct(F.split("normal", " "))
    words = _normal_lines(docs).select(*keys, F.posexplode(words).alias("at", "word"))
    words = words.select(*keys, F.expr(f"at div {_CHUNK}").alias("chunk"), F.xxhash64("word").alias("h"))
    parts = stage(_simhash(words, (*keys, "chunk")), "line-parts")
    # Longer lines: the SimHash of the chunks' SimHashes.
    long = parts.where("chunk > 0").select(*keys).distinct()
    if long.isEmpty():
        return parts.drop("chunk")
    chunks = parts.join(long, list(keys), "left_semi").withColumnRenamed("simhash", "h")
    whole = parts.join(long, list(keys), "left_anti").select(*keys, "simhash")
    return stage(whole.unionAll(_simhash(chunks, keys)), "line-hashes")


def _only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is in the column `key` of `wanted`.

    Rows without a wanted key of the same remainder, nearly all, go before anything is shuffled.
    """
    remainder = F.expr(f"cast(pmod(xxhash64({key}), {_REMAINDERS}) as int)")
    few = F.broadcast(wanted.select(remainder.alias("__few")).distinct())
    near = rows.withColumn("__remainder", remainder).join(few, F.col("__remainder") == F.col("__few"), "left_semi")
    return near.drop("__remainder").join(wanted, key)


def _close(pairs: DataFrame, texts: DataFrame, cfg: LineConfig) -> DataFrame:
    """Pairs (a, b) of line ids whose edit similarity reaches the threshold."""
    side = lambda p: texts.select(F.col("line_id").alias(p), F.col("normal").alias(f"t{p}"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    longer, shorter = F.greatest(F.length("ta"), F.length("tb")), F.least(F.length("ta"), F.length("tb"))
    rows = rows.withColumn("allowed", F.floor(longer * (1 - cfg.similarity) + 1e-9).cast("int"))
    # Spark walks both texts for every cell it fills, so long texts cost their square, whatever the limit. The distances of
    # pieces at the same places add up to the distance of the texts at least, and settle most pairs; larger pieces bear
    # larger shifts. What no size of piece settles is compared as a whole.
    longest = "greatest(length(ta), length(tb))"
    apart = ("aggregate(sequence(0, ({longest} - 1) div {k}), 0, (s, i) -> "
             "s + levenshtein(substring(ta, i * {k} + 1, {k}), substring(tb, i * {k} + 1, {k})))")
    settled = [f"when {longest} > {k} and {apart.format(longest=longest, k=k)} <= allowed then true" for k in _PIECES]
    near = f"case {' '.join(settled)} else levenshtein(ta, tb, allowed) >= 0 end"
    return rows.where(longer - shorter <= F.col("allowed")).where(near).select("a", "b")


def line_groups(docs: DataFrame, cfg: LineConfig = LineConfig()) -> tuple[DataFrame, DataFrame]:
    """Occurrences (row_key, doc, line, line_id) and groups (line_id, root, rows) of linked distinct lines."""
    occurrences = _occurrences(docs)
    distinct = stage(occurrences.groupBy("line_id").agg(
        F.first("simhash").alias("simhash"), F.count(F.lit(1)).alias("rows"), F.min("raw_id").alias("raw_id")), "line-distinct")
    block = [f"(shiftrightunsigned(simhash, {16 * i}) & 65535L)" for i in range(4)]
    keys = [f"{n}L * 4294967296L + {block[i]} * 65536L + {block[k]}" for n, (i, k) in enumerate(combinations(range(4), 2))]
    blocks = distinct.select("line_id", F.explode(F.array(*[F.expr(k) for k in keys])).alias("block"))
    heads = blocks.groupBy("block").agg(F.min("line_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = stage(heads.select("block", "head"), "line-heads")
    met = stage(_only(blocks, "block", heads).select("line_id", "block", "head"), "line-met")
    # The text of a line that met another, from occurrences of one wording; lines are normalised once they are few.
    some = stage(distinct.join(met.select("line_id").distinct(), "line_id", "left_semi").select("raw_id"), "line-some")
    raw = lines_of(docs).select(F.xxhash64("text").alias("raw_id"), "text")
    raw = _only(raw, "raw_id", some).dropDuplicates(["raw_id"]).select(normalised(F.col("text")).alias("normal"))
    texts = stage(raw.select(F.xxhash64("normal").alias("line_id"), "normal"), "line-texts")
    # Every line against the head of its blocks, then lines of blocks that still hold several groups.
    first = met.where("line_id != head").select(F.col("line_id").alias("a"), F.col("head").alias("b")).distinct()
    first = stage(_close(first, texts, cfg), "line-first")
    roots = components(first, "a", "b", "lines").withColumnRenamed("node", "line_id")
    rooted = met.select("block", "line_id").join(roots, "line_id", "left").withColumn(
        "root", F.coalesce("component", "line_id")).drop("component")
    rooted = stage(rooted, "line-rooted")
    mixed = rooted.groupBy("block").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("line_id").alias("head"))
    mixed = mixed.where("r0 != r1").select("block", "head")
    open_lines = stage(rooted.join(mixed, "block"), "line-open").where("line_id != head")
    x, y = open_lines.alias("x"), open_lines.alias("y")
    second = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.line_id") < F.col("y.line_id"))
                    & (F.col("x.root") != F.col("y.root")))
    second = second.select(F.col("x.line_id").alias("a"), F.col("y.line_id").alias("b")).distinct()
    linked = first.unionAll(_close(second, texts, cfg))
    roots = components(linked, "a", "b", "lines").withColumnRenamed("node", "line_id")
    groups = distinct.join(roots, "line_id", "left").select(
        "line_id", F.coalesce("component", "line_id").alias("root"), "rows",
        F.col("component").isNotNull().alias("fuzzy"))
    return occurrences.drop("simhash", "raw_id"), groups


def removed_lines(docs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """(row_key, lines): the numbers of the lines that go, for documents that lose any."""
    occurrences, groups = line_groups(docs, cfg)
    groups = stage(groups.where("rows > 1 or fuzzy").select("line_id", "root"), "line-groups")
    copied = stage(occurrences.join(groups, "line_id").select("row_key", "doc", "line", "root"), "line-copied")
    keep = copied.groupBy("root").agg(F.min(F.struct("doc", "row_key", "line")).alias("k")).select(
        "root", F.col("k.row_key").alias("keep_key"), F.col("k.line").alias("keep_line"))
    gone = copied.join(keep, "root").where("row_key != keep_key or line != keep_line")
    return gone.groupBy("row_key").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """The documents with all their columns, text without the lines that go, and n_lines and n_removed beside them.

    Of each connected group of lines the occurrence with the smallest doc_id, then line, stays. Lines without letters
    or digits are layout and stay. Null texts stay null and empty ones empty. Equal rows are one document, so each of
    them keeps the same lines; rows that share an id but not the text are different documents. A text that had lines
    but lost all of them is empty. An empty table gives no rows. Columns named n_lines or n_removed are replaced.
    """
    gone = removed_lines(docs, cfg).withColumnsRenamed({"row_key": "__row_key", "lines": "__lines"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__row_key", F.xxhash64("doc_id", text)).join(gone, "__row_key", "left")
    parts = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__lines"))
    # The parts are a variable of an outer function: the inner one would part the text again for every line.
    kept = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(places, lambda i: F.get(p, i)), "\n")), F.lit(0))
    out = rows.withColumns({
        "n_lines": F.size(parts).cast("long"), "n_removed": F.coalesce(F.size("__lines"), F.lit(0)).cast("long"),
        "text": F.when(F.col("__lines").isNull(), F.col("text")).otherwise(kept)})
    return out.drop("__row_key", "__lines")
