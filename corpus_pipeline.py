"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes the documents that the one before kept, as a written table, and calls one operator of the library.
All stages but the last return documents with the columns they came with.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from undercroft.llm.common import table
from undercroft.session import stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Near-duplicate documents share eight tenths of their five-word shingles.
NEAR = jaccard.JaccardConfig(words=5, num=80, den=100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled texts does not call toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; those left without a letter or digit go.

    n_chars is that of the new text. Texts without any letter or digit to begin with are no copies and stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", row))
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    counted = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text"))
    changed = {"text": F.col("text"), "n_chars": counted.cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs, NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's question and answer."""
    key = F.xxhash64("doc_id", "text")
    leaks = decontaminate.find_leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = stage(leaks.select(F.col("doc_id").alias("__row_key")).distinct(), "pipeline-leaks")
    return docs.withColumn("__row_key", key).join(leaks, "__row_key", "left_anti").drop("__row_key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, packed into sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]

#: No SQL: the first stage fits a model, and the pairs of the others would be all pairs of a corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each from the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
