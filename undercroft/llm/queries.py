"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.llm import (
    decontaminate,
    jaccard,
    line_dedup,
    maxscore,
    oracles,
    packing,
    resampling,
    suffix_dedup,
    surrogates,
    token_tree,
    toxicity,
    urlgraph,
    vafile,
    weak_rules,
)
from undercroft.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


RULES = (
    urlgraph.Rule("allow", "org", "/"),
    urlgraph.Rule("block", "example.org", "/es/"),
    urlgraph.Rule("block", "example.org", "/en/1"),
    urlgraph.Rule("allow", "com", "/fr/"),
    urlgraph.Rule("block", "com", "/de/"),
)


@query("op7_url_link_graph")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page verdicts from the rules, else from trust and distrust of the host."""
    return urlgraph.judge_pages(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op8_maxscore_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search_table(table(spark, sf_dir, "embeddings"), k=5, every=50)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_ngram_jaccard_join", oracles.NGRAM_JACCARD)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(table(spark, sf_dir, "documents"))


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_fuzzy_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; the text is shown by its length and digest."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"),
                       F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question", "answer")})


@query("op5_edit_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a feed of revisions, and what was encoded again for it."""
    counted = token_tree.count_revised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), TOKENIZER)
    return counted.select("doc_id", "tokens_before", "tokens_after", "chars", "chars_encoded", "nodes_renewed",
                          F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: The queries' key; a real run takes its own from the caller.
KEY = "queries"


@query("op6_pii_surrogates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    texts, _ = surrogates.replace_entities(table(spark, sf_dir, "documents"), surrogates.SurrogateConfig(KEY))
    return texts.select("doc_id", "n_entities", "text")


@query("op11_va_file_centroids", oracles.centroids_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.cluster_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_importance_resampling", oracles.IMPORTANCE_RESAMPLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_quality_weak_supervision")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
