"""JSON documents (model metrics, build summary) and the prediction export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undercroft.functions.text import risk_title
from undercroft.schemas import METRICS_DOC

METRIC_FIELDS = ("threshold", "precision", "recall", "positives_pred", "positives_true", "n", "pr_auc")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics document as one row, or no row when it is missing or broken."""
    try:
        doc = spark.read.schema(METRICS_DOC).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], METRICS_DOC)
    return doc


def metrics_rows(doc: DataFrame, split: str = "test") -> DataFrame:
    """One split of the document -> long rows (split, method, risk, metrics)."""
    by_method = doc.select(F.explode(split).alias("method", "by_risk"))
    rows = by_method.select("method", F.explode("by_risk").alias("risk", "m"))
    return rows.select(F.lit(split).alias("split"), "method", "risk", *[F.col(f"m.{f}").alias(f) for f in METRIC_FIELDS])


def metrics_thresholds(doc: DataFrame, method: str) -> DataFrame:
    """(risk_type, threshold) of one method; empty when the document lacks it."""
    return doc.select(F.explode(F.col("thresholds")[method]).alias("risk_type", "threshold"))


def _nested(rows: DataFrame, outer: str, inner: str, value: Column) -> DataFrame:
    """Long rows -> one row with a map of maps. Both levels are code lists (methods, risks) of a few entries."""
    level = rows.groupBy(outer).agg(F.map_from_entries(F.collect_list(F.struct(F.col(inner), value))).alias("m"))
    return level.agg(F.map_from_entries(F.collect_list(F.struct(outer, "m"))).alias("m"))


def metrics_document(
    metrics: DataFrame, thresholds: DataFrame, counts: DataFrame, features: Sequence[str],
    importances: DataFrame | None = None,
) -> DataFrame:
    """Long metric rows (splits valid and test) -> the one-row document.

    `counts` is one row with n_train, n_valid, n_test; `importances` has risk, feature, and gain or mean_abs_shap.
    """
    value = F.struct(*METRIC_FIELDS)
    doc = counts.withColumn("thresholds", _nested(thresholds, "method", "risk", F.col("threshold")).scalar())
    for split in ("valid", "test"):
        part = _nested(metrics.filter(F.col("split") == split), "method", "risk", value)
        doc = doc.withColumn(split, part.scalar())
    if importances is not None:
        by = "mean_abs_shap" if "mean_abs_shap" in importances.columns else "gain"
        top = importances.groupBy("risk").agg(F.reverse(F.array_sort(F.collect_list(F.struct(by, "feature")))).alias("f"))
        shap = top.agg(F.map_from_entries(F.collect_list(F.struct(
            "risk", F.transform("f", lambda x: F.struct(x["feature"].alias("feature"), x[by].alias(by)))
        ))).alias("shap"))
        doc = doc.withColumn("shap", shap.scalar())
    return doc.withColumns({
        "features": F.array(*[F.lit(f) for f in features]),
        "trained_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
    })


def with_retraining(doc: DataFrame, report: dict[str, tuple[int, int]]) -> DataFrame:
    """The document with the time of a retraining, and its decisions and trees by risk."""
    entries = [x for risk, (n, trees) in sorted(report.items())
               for x in (F.lit(risk), F.struct(F.lit(n).cast("long").alias("n"), F.lit(trees).cast("long").alias("trees")))]
    kind = doc.schema["retrain"].dataType
    return doc.withColumns({
        "retrain": F.create_map(*entries).cast(kind) if entries else F.lit(None).cast(kind),
        "retrained_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
    })


def write_document(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").json(path)


def export_rows(predictions: DataFrame) -> DataFrame:
    """Named predictions -> the columns of the dispatcher's file."""
    return predictions.select(
        "id",
        F.coalesce("object_name", F.col("object_id").cast("string"), F.lit("")).alias("object"),
        risk_title(F.col("risk_type")).alias("risk"),
        F.format_string("%.3f", F.col("probability")).alias("probability"),
        "status",
        "source",
        F.col("horizon_hours").alias("horizon"),
    )


def write_export(predictions: DataFrame, path: str) -> None:
    """Semicolon-separated file with a header; quotes inside names are doubled."""
    (
        export_rows(predictions)
        .write.mode("overwrite")
        .option("header", "true")
        .option("sep", ";")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
