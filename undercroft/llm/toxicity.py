"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

A lexicon is mined from labelled texts; what the trees see are densities and rates, never words, ids or languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undercroft.session import stage

# Second-person words of the corpus languages (English, German, Spanish, French).
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deiner deinen ihr euch euer eure "
    "tú tu tus te ti usted ustedes vosotros vuestro toi ton ta tes vous votre vos".split())
# Characters written in place of letters.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = ("log_words", "hits", "density", "weight", "weight_density", "peak", "stem_hits", "stem_density",
            "stem_weight", "near_second_person", "second_person", "capitals", "shouted", "exclaimed", "punctuation",
            "obfuscated", "obfuscated_hits", "stretched")
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[^\W\d_]+(?:[0-9@$!*._\-]+[^\W\d_]+)+")
_STRETCH = re.compile(r"(.)\1{2,}")
#: Words whose reading a task remembers at most.
MEMO = 500_000


@dataclass(frozen=True)
class ToxicityConfig:
    #: Most labelled texts a model is fitted on, those with the smallest hashes of the id.
    sample: int = 20_000
    #: Entries of the lexicon at most, the least toxic texts that must hold one, and the least log odds.
    lexicon: int = 4_000
    support: int = 3
    odds: float = 1.0
    #: Lengths of the word beginnings that stand in the lexicon beside whole words.
    stems: tuple[int, ...] = (4, 5)
    #: Parts of the sample: the trees are fitted on all but the last, which calibrates them.
    folds: int = 3
    #: Words on either side of a lexicon word among which a second-person word counts.
    reach: int = 5
    rounds: int = 30
    depth: int = 3
    threshold: float = 0.7


def read_word(word: str) -> tuple[str, bool, bool]:
    """(plain form, disguised, stretched): lower case, outer punctuation off, look-alikes and inner marks undone."""
    low = _EDGE.sub("", word).lower()
    disguised = bool(_INNER.fullmatch(low)) and not low.replace("-", "").isalpha()
    if disguised:
        low = re.sub(r"[\W\d_]+", "", low.translate(DISGUISES))
    short = _STRETCH.sub(r"\1", low)
    return short, disguised, short != low


def _entries(plain: str, stems: tuple[int, ...]) -> list[str]:
    """Lexicon keys of a word: itself, and its beginnings where it is longer."""
    return [plain, *(f"^{plain[:n]}" for n in stems if len(plain) > n)] if plain else []


def _count_entries(stems: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def drain():
            found = [(*key, n) for key, n in counts.items()]
            counts.clear()
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], ["entry", "fold", "toxic", "n"])
        for batch in batches:
            for text, fold, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                plain = {read_word(w)[0] for w in (text or "").split()}
                counts.update((e, fold, toxic) for e in {e for p in plain for e in _entries(p, stems)})
            if len(counts) > MEMO:
                yield drain()
        yield drain()
    return run


def mine_lexicons(texts: DataFrame, cfg: ToxicityConfig) -> list[dict[str, float]]:
    """Log odds of words and word beginnings that mark toxic texts; `texts` has text, toxic (0 or 1) and fold.

    One lexicon for each fold, mined from the other folds, and at the end one mined from all. What counts is the lower
    end of the odds' 95 % range, so that a word seen in a few toxic texts by chance weighs little; copies of a text
    count once. A lexicon has at most cfg.lexicon entries, those with the largest odds.
    """
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold"))
    sizes = {(r["fold"], r["toxic"]): r["n"]
             for r in texts.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = texts.select("text", F.col("fold").cast("int"), F.col("toxic").cast("int")).mapInArrow(
        _count_entries(cfg.stems), "entry string, fold int, toxic int, n long")
    total = lambda fold, toxic: F.sum(
        F.when((F.col("fold") != fold) & (F.col("toxic") == toxic), F.col("n")).otherwise(0))
    folds = [*range(cfg.folds), -1]
    wide = stage(counted.groupBy("entry").agg(
        *[total(k, t).alias(f"n{k}_{t}") for k in folds for t in (0, 1)]), "toxic-words")
    found = []
    for k in folds:
        clean, toxic = (sum(n for (f, t), n in sizes.items() if f != k and t == kind) for kind in (0, 1))
        t, c = F.col(f"n{k}_1") + 0.5, F.col(f"n{k}_0") + 0.5
        odds = F.log(t / (toxic + 1.0)) - F.log(c / (clean + 1.0)) - 1.64 * F.sqrt(1 / t + 1 / c)
        best = wide.where(t >= cfg.support).select("entry", odds.alias("odds")).where(F.col("odds") >= cfg.odds)
        rows = best.orderBy(F.desc("odds"), "entry").limit(cfg.lexicon).collect()
        found.append({r["entry"]: r["odds"] for r in rows})
    return found


def text_features(text: str, lexicon: dict[str, float], cfg: ToxicityConfig, memo: dict) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES; an empty text has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    if len(memo) > MEMO:
        memo.clear()
    marks = []
    for i, word in enumerate(words):
        mark = memo.get(word)
        if mark is None:
            plain, disguised, stretched = read_word(word)
            whole = lexicon.get(plain, 0.0)
            begin = max((lexicon.get(f"^{plain[:n]}", 0.0) for n in cfg.stems if len(plain) > n), default=0.0)
            shouted = len(word) > 2 and word.isupper()
            second = plain in SECOND_PERSON
            mark = (whole, begin, disguised, stretched, shouted, second)
            mark = memo[word] = mark if any(mark) else ()
        if mark:
            marks.append((i, mark))
    hits = [(i, m) for i, m in marks if m[0] or m[1]]
    second = [i for i, m in marks if m[5]]
    near = 0
    if hits and second:
        at = np.array(second)
        place = np.array([i for i, _ in hits])
        found = np.searchsorted(at, place + cfg.reach, side="right") - np.searchsorted(at, place - cfg.reach)
        near = int((found > 0).sum())
    whole = [m[0] for _, m in hits if m[0]]
    begin = [m[1] for _, m in hits if m[1]]
    chars = max(1, len(text))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÑÁÍÓÚÇ"))
    exclaimed = text.count("!") + text.count("?")
    marks_of = exclaimed + sum(map(text.count, ".,;:*#%&$\"'()-"))
    return [
        float(np.log1p(n)), float(len(whole)), len(whole) / n, sum(whole), sum(whole) / n,
        max((m[0] + m[1] for _, m in hits), default=0.0), float(len(begin)), len(begin) / n, sum(begin), near / n,
        len(second) / n, upper / chars, sum(1 for _, m in marks if m[4]) / n, exclaimed / n, marks_of / chars,
        sum(1 for _, m in marks if m[2]) / n, float(sum(1 for _, m in hits if m[2])), sum(1 for _, m in marks if m[3]) / n,
    ]


def features(texts: DataFrame, lexicons: list[dict[str, float]], cfg: ToxicityConfig, keep: tuple[str, ...]) -> DataFrame:
    """Adds `features` (array of doubles) of the column text; of the others only `keep` are read.

    A row with a column fold is read with that fold's lexicon, a row without with the last one.
    """
    shared = texts.sparkSession.sparkContext.broadcast(lexicons)  # bounded by cfg.lexicon and cfg.folds
    fold_at = keep.index("fold") + 1 if "fold" in keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict] = [{} for _ in shared.value]
        for batch in batches:
            folds = batch.column(fold_at).to_pylist() if fold_at else [-1] * batch.num_rows
            rows = [text_features(t.as_py() or "", shared.value[k], cfg, memos[k]) for t, k in zip(batch.column(0), folds)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], [*keep, "features"])

    rows = texts.select(F.col("text").cast("string").alias("__text"), *keep)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """(doc_id, text, toxic, fold): at most cfg.sample labelled texts outside the held-out third.

    Labels other than 0 and 1 and null ids are left out; several labels of one id count as toxic if one of them is.
    Folds go by a hash of the id.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    ids = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = stage(ids.withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit(2 ** 62 - 1))), "toxic-ids")
    total = ids.count()
    if total > 2 * cfg.sample:
        # Hashes are even, so a cut a little over the share leaves few rows to put in order.
        ids = ids.where(F.col("h") < int(2 ** 62 * 1.5 * cfg.sample / total))
    ids = ids.orderBy("h", "doc_id").limit(cfg.sample).drop("h")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most cfg.sample rows of two numbers: small by the parameter.
    found = texts.join(F.broadcast(ids), "doc_id")
    return found.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(cfg.folds)).cast("int"))


def rate(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """Every row of `docs` as a struct `row`, with its score and predicted (1 from cfg.threshold on).

    The texts of a fold are read with a lexicon mined from the other folds, so that neither the trees nor the
    calibration see features shaped by their own texts; the last fold calibrates, the others grow the trees. Null texts
    count as empty. Repeated rows are scored each. Without labels of both kinds in every fold the score is the sample's
    share of toxic texts (0 without labels). An empty table gives no rows. Columns of any names are carried along.
    """
    sample = stage(labelled_sample(docs, labels, cfg), "toxic-sample")
    kinds = {(r["fold"], r["toxic"]): r["n"]
             for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    if not all(kinds.get((fold, toxic)) for fold in range(cfg.folds) for toxic in (0, 1)):
        base = sum(n for (_, t), n in kinds.items() if t) / max(1, sum(kinds.values()))
        scored = rows.select("row", F.lit(base).alias("score"))
    else:
        lexicons = mine_lexicons(sample, cfg)
        known = stage(features(sample, lexicons, cfg, ("toxic", "fold")), "toxic-features")
        vector = array_to_vector("features").alias("features")
        known = known.select("fold", F.col("toxic").cast("double").alias("label"), vector).coalesce(2)
        last = cfg.folds - 1
        trees = GBTClassifier(maxIter=cfg.rounds, maxDepth=cfg.depth, stepSize=0.2, seed=7, minInstancesPerNode=3).fit(
            known.where(F.col("fold") != last))
        margin = vector_to_array("rawPrediction")[1].alias("margin")
        curve = trees.transform(known.where(F.col("fold") == last)).select("label", margin)
        steps = IsotonicRegression(featuresCol="margin").fit(curve)
        raw = features(rows, lexicons, cfg, ("row",)).select("row", vector)
        scored = steps.transform(trees.transform(raw).select("row", margin))
        scored = scored.select("row", F.col("prediction").alias("score"))
    scored = scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
    return scored.withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))


def score(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; see `rate`."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The text itself need not travel further than its features.
    rated = rate(narrow, labels, cfg).select(F.col("row.doc_id").alias("doc_id"), "score", "predicted")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The documents, all columns, that are not predicted toxic."""
    return rate(docs, labels, cfg).where("predicted = 0").select("row.*")
