"""Quality by weak supervision: rules vote or abstain, and what they are worth is learnt from how they agree.

No label is read. Expectation-maximisation estimates how often each rule that votes is right about good texts and about
bad texts of several kinds; a text's posterior probability of being good replaces passing every rule.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.session import stage

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_END = re.compile(rb"[.!?][\"')]*$")
#: Words of a window whose repetition counts.
WINDOW = 5
_INT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals",
        "n_shouts", "n_doubled", "n_ends")
MEASURES = "doc_id long, " + ", ".join(f"{c} long" for c in _INT)


@dataclass(frozen=True)
class Rule:
    """Votes for a text where `good` holds, against it where `bad` holds, and abstains otherwise; both read measures."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]


def share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _between(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value <= high)


def _read() -> Column:
    """Texts with enough words for a share to mean something."""
    return F.col("n_words") >= 20


RULES = (
    Rule("length", lambda: F.col("n_words") >= 40, lambda: F.col("n_words") < 10),
    Rule("word_length", lambda: _read() & _between(share("word_chars"), 3, 10),
         lambda: ~_between(share("word_chars"), 2, 20) & (F.col("n_words") > 0)),
    Rule("symbols", lambda: _read() & (share("n_symbols") <= 0.01), lambda: share("n_symbols") >= 0.1),
    Rule("repeated_lines", lambda: (F.col("n_lines") >= 4) & (share("n_dup_lines", "n_lines") <= 0.1),
         lambda: share("n_dup_lines", "n_lines") >= 0.3),
    Rule("repeated_words", lambda: _read() & (share("n_repeat_words") <= 0.05), lambda: share("n_repeat_words") >= 0.2),
    Rule("doubled_words", lambda: _read() & (share("n_doubled") <= 0.02), lambda: share("n_doubled") >= 0.2),
    Rule("capitals", lambda: _read() & (share("n_capitals", "n_letters") <= 0.15),
         lambda: _read() & (share("n_capitals", "n_letters") >= 0.4)),
    Rule("shouts", lambda: _read() & (share("n_shouts") <= 0.05), lambda: _read() & (share("n_shouts") >= 0.25)),
    Rule("letters", lambda: _read() & (share("n_letters", "word_chars") >= 0.85),
         lambda: (F.col("n_words") > 0) & (share("n_letters", "word_chars") <= 0.6)),
    Rule("sentences", lambda: _read() & _between(share("n_ends"), 0.02, 0.3),
         lambda: (F.col("n_words") >= 100) & (F.col("n_ends") == 0)),
)


@dataclass(frozen=True)
class QualityConfig:
    rules: tuple[Rule, ...] = RULES
    #: A text is kept from this posterior on.
    keep: float = 0.5
    #: Rounds at most; estimates that move less than `settled` have settled.
    rounds: int = 1000
    settled: float = 1e-9
    #: The share of good texts that a rule votes against at most, of those it votes on.
    wrong: float = 0.02
    #: What estimation starts from: the share of good texts, how often a vote for a text is cast for a good one, and for
    #: a bad one by rules that see its fault and by others.
    prior: float = 0.8
    for_good: float = 0.98
    for_seen: float = 0.1
    for_unseen: float = 0.8
    #: Votes of each kind that every rule is taken to have cast beforehand, as those figures say.
    weight: float = 4.0


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in a window of n words found twice or more in the list, the first included.

    Windows meet by a hash of their words; those that meet are compared word by word.
    """
    if len(words) <= n:
        return 0
    code = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + code[k:len(words) - n + 1 + k]
        mixed ^= mixed >> np.uint64(29)
    _, place, times = np.unique(mixed, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(times[place] > 1)
    if not len(maybe):
        return 0
    windows = [tuple(words[i:i + n]) for i in maybe.tolist()]
    counts = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for i, w in zip(maybe.tolist(), windows) if counts[w] > 1], dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + n, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure_text(text: str) -> tuple[int, ...]:
    """The measures of one whole text, in the order of MEASURES."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    letters = [w for w in text if w.isalpha()] if not text.isascii() else None
    if letters is None:
        upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        n_letters = upper + sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    else:
        n_letters, upper = len(letters), sum(1 for c in letters if c.isupper())
    return (
        len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines), n_letters, upper,
        text.count("!") + text.count("?"), sum(a == b for a, b in zip(words, words[1:])),
        sum(1 for w in words if _END.search(w)),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure_text(t.as_py() or "") for t in batch.column(1)]
        columns = zip(*rows) if rows else [()] * len(_INT)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *_INT])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measures) of every whole text; a null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, MEASURES)


def votes(measures: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds `votes`, one character a rule: + for the text, - against it, 0 for an abstention; against wins."""
    cast = [F.when(r.bad(), "-").when(r.good(), "+").otherwise("0") for r in rules]
    return measures.withColumn("votes", F.concat(*cast))


@dataclass(frozen=True)
class Worth:
    """What the rules are worth: the share of each kind of text, and how often each rule that votes votes for it.

    Kind 0 is good; kind r + 1 is bad in the way that rule r sees. Several kinds are needed because faults come one at
    a time: the rules that look for the others vote for such a text, and they agree with each other about it.
    """

    share: np.ndarray
    plus: np.ndarray

    def kinds(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of each kind (column) for each row of votes (1, -1, 0)."""
        odds = np.log(self.share) + (pattern > 0) @ np.log(self.plus).T + (pattern < 0) @ np.log1p(-self.plus).T
        odds = np.exp(odds - odds.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def estimate(pattern: np.ndarray, counts: np.ndarray, cfg: QualityConfig) -> Worth:
    """Expectation-maximisation over vote patterns and how many texts cast each.

    The starting figures stand as a few votes cast beforehand, so that no estimate becomes 0 or 1. The one assumption
    about good texts is cfg.wrong; without it a fault that many texts share could as well pass for a trait of good ones.
    """
    n = pattern.shape[1]
    start = np.full((n + 1, n), cfg.for_unseen)
    start[0] = cfg.for_good
    start[np.arange(1, n + 1), np.arange(n)] = cfg.for_seen
    prior = np.array([cfg.prior, *[(1 - cfg.prior) / n] * n])
    worth = Worth(prior, np.vstack([np.maximum(start[:1], 1 - cfg.wrong), start[1:]]))
    plus, minus = (pattern > 0).astype(float), (pattern < 0).astype(float)
    for _ in range(cfg.rounds):
        texts = worth.kinds(pattern) * counts[:, None]
        voted_for, against = texts.T @ plus, texts.T @ minus
        chance = (voted_for + cfg.weight * start) / (voted_for + against + cfg.weight)
        chance[0] = np.maximum(chance[0], 1 - cfg.wrong)
        new = Worth((texts.sum(axis=0) + cfg.weight * prior) / (counts.sum() + cfg.weight), chance)
        moved = max(np.abs(new.share - worth.share).max(), np.abs(new.plus - worth.plus).max(initial=0))
        worth = new
        if moved < cfg.settled:
            break
    return worth


def learn(voted: DataFrame, cfg: QualityConfig = QualityConfig()) -> dict[str, float]:
    """Posterior of every vote pattern in the table.

    Patterns are counted by the tasks first; there are 3 ** rules at most (59 049 for ten rules), however many texts.
    """
    found = sorted((r["votes"], r["n"]) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())
    if not found:
        return {}
    sign = {"+": 1, "-": -1, "0": 0}
    pattern = np.array([[sign[c] for c in p] for p, _ in found], dtype=np.int64)
    counts = np.array([n for _, n in found], dtype=float)
    return dict(zip((p for p, _ in found), estimate(pattern, counts, cfg).kinds(pattern)[:, 0].tolist()))


def judge(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, quality (the posterior) and votes of every document.

    Base: fewer than 10 words, or over a fifth of the words in repeated five-word windows, fails and is not kept;
    others are kept from a posterior of cfg.keep on. Rules learn from all documents, those that fail included. Reads
    doc_id and text only. A null or empty text has no words, no votes but that of its length, and fails. Repeated rows
    are judged each; a null doc_id stays null; an empty table gives no rows.
    """
    voted = stage(votes(measure(docs), cfg.rules), "quality-votes")
    learnt = docs.sparkSession.createDataFrame(
        list(learn(voted, cfg).items()), "votes string, quality double")  # 3 ** rules rows at most
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.join(F.broadcast(learnt), "votes").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality") >= cfg.keep)).alias("kept"), F.round("quality", 9).alias("quality"), "votes")


def filter_quality(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents, all columns, that are kept; rows of one id and text are judged alike."""
    key = F.xxhash64("doc_id", "text")
    judged = judge(docs.select(key.alias("doc_id"), "text"), cfg).where("kept").select(F.col("doc_id").alias("__key"))
    return docs.withColumn("__key", key).join(judged.distinct(), "__key", "left_semi").drop("__key")
