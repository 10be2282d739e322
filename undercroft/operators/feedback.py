"""Dispatcher decisions: applying them, tickets, calibration of thresholds, training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.config import DECISION_TITLES, DECISIONS, RISKS
from undercroft.functions import scores, text
from undercroft.functions.calendar import hour_number, hour_timestamp
from undercroft.operators.rows import first_per_key

# Fixed labels and weights of the feedback training set.
DECISION_LABELS = {"dispatch": 1.0, "maintenance": 1.0, "false_alarm": 0.0}
NEGATIVE_WEIGHT, POSITIVE_WEIGHT = 3.0, 2.0
#: Equal training rows that stay rows of their own: more than any least number of rows in a leaf.
COPIES = 4096


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows that are never broadcast: one for each prediction. Spark takes a few columns of a compressed file for small,
    whatever the number of rows, and would hold them all in the driver."""
    return rows.hint("merge")


def split_decisions(decisions: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(legal decisions on known predictions, rejected ones with the reason)."""
    known = predictions.select(F.col("id").alias("prediction_id"), F.lit(True).alias("_known"))
    marked = decisions.join(_shuffled(known), "prediction_id", "left")
    problem = F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "illegal decision").when(
        F.col("_known").isNull(), "unknown prediction"
    )
    marked = marked.withColumn("problem", problem).drop("_known")
    return marked.filter(F.col("problem").isNull()).drop("problem"), marked.filter(F.col("problem").isNotNull())


def apply_decisions(predictions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Status of a prediction becomes its latest decision."""
    latest = first_per_key(
        accepted.select("prediction_id", "decision", "decided_at"), ["prediction_id"],
        [F.desc("decided_at"), F.asc("decision")],
    ).select(F.col("prediction_id").alias("id"), "decision")
    return (
        predictions.join(_shuffled(latest), "id", "left")
        .withColumn("status", F.coalesce("decision", "status"))
        .select(*predictions.columns)
    )


def feedback_rows(accepted: DataFrame) -> DataFrame:
    """Rows to append to the feedback journal."""
    return accepted.select(
        "prediction_id", "decision", "reason", "user_login", F.col("decided_at").alias("created_at")
    )


def ticket_drafts(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Drafts for decisions or requests on predictions.

    Given values win; otherwise the title names the risk and object, and the body is the first of reason,
    recommendation, explanation that is not empty.
    """

    def filled(column):
        return F.nullif(column, F.lit(""))

    cols = set(requests.columns)

    def given(name):
        return filled(F.col(f"r.{name}")) if name in cols else F.lit(None).cast("string")

    object_id = F.col("r.object_id") if "object_id" in cols else F.lit(None).cast("bigint")
    joined = requests.alias("r").join(_shuffled(predictions.alias("p")), F.col("r.prediction_id") == F.col("p.id"), "left")
    auto_title = F.concat(
        text.risk_title(F.col("p.risk_type")), F.lit(": объект "),
        F.coalesce(F.col("p.object_id").cast("string"), F.lit("None")),
    )
    return joined.select(
        F.col("r.prediction_id").alias("prediction_id"),
        F.coalesce(F.nullif(object_id, F.lit(0)), F.col("p.object_id")).alias("object_id"),
        F.coalesce(given("title"), auto_title).alias("title"),
        F.coalesce(
            given("body"), given("reason"), filled(F.col("p.recommendation")), F.col("p.explanation")
        ).alias("body"),
        F.lit("draft").alias("status"),
    ).filter(F.col("title").isNotNull())


def send_tickets(tickets: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Marks drafts as sent with an external id: those in `chosen` (column id), else the newest draft."""
    if chosen is None:
        chosen = tickets.filter(F.col("status") == "draft").agg(F.max("id").alias("id"))
    hit = chosen.select("id").distinct().withColumn("_sent", F.lit(True))
    sent = F.coalesce(F.col("_sent"), F.lit(False))
    return (
        tickets.join(_shuffled(hit), "id", "left")
        .withColumns({
            "status": F.when(sent, "sent").otherwise(F.col("status")),
            "external_id": F.when(sent, F.format_string("ODS-%06d", F.col("id"))).otherwise(F.col("external_id")),
        })
        .select(*tickets.columns)
    )


def decision_counts(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Decisions per risk. Feedback is counted per prediction first, so a much-discussed prediction is one row."""
    per_prediction = feedback.groupBy("prediction_id", "decision").agg(F.count(F.lit(1)).alias("n"))
    risks = predictions.select(F.col("id").alias("prediction_id"), "risk_type")
    return (
        per_prediction.join(_shuffled(risks), "prediction_id").groupBy("risk_type", "decision").agg(F.sum("n").alias("n"))
    )


def _risk_list(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([(r,) for r in RISKS], "risk_type string")


def base_thresholds(like: DataFrame, known: DataFrame | None = None, default: float = 0.5) -> DataFrame:
    """A threshold for each of the four risks: the model's own where it has one, else the default."""
    risks = _risk_list(like)
    if known is None:
        return risks.withColumn("threshold", F.lit(default))
    known = known.select("risk_type", F.col("threshold").cast("double").alias("_known"))
    return risks.join(known, "risk_type", "left").select(
        "risk_type", F.coalesce("_known", F.lit(default)).alias("threshold")
    )


def effective_thresholds(base: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Calibrated thresholds win over base ones. Both hold one row per risk."""
    over = calibrated.select("risk_type", F.col("threshold").alias("_over"))
    return base.join(over, "risk_type", "left").select(
        "risk_type", F.coalesce("_over", "threshold").alias("threshold")
    )


def calibrate(base: DataFrame, feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """New thresholds from feedback; all four risks are always present, `watch` is ignored."""
    counts = (
        decision_counts(feedback, predictions)
        .groupBy("risk_type")
        .agg(
            F.sum(F.when(F.col("decision") == "false_alarm", F.col("n"))).alias("_false"),
            F.sum(F.when(F.col("decision").isin("dispatch", "maintenance"), F.col("n"))).alias("_dispatch"),
        )
    )
    zero = F.lit(0).cast("bigint")
    joined = base.join(counts, "risk_type", "left").select(
        "risk_type",
        F.col("threshold").alias("_base"),
        F.coalesce("_false", zero).alias("n_false_alarm"),
        F.coalesce("_dispatch", zero).alias("n_dispatch"),
    )
    shift = scores.feedback_shift(F.col("n_false_alarm"), F.col("n_dispatch"))
    return joined.select(
        "risk_type",
        F.round("_base", 3).alias("base_threshold"),
        scores.shifted_threshold(F.col("_base"), shift).alias("threshold"),
        F.round(shift, 3).alias("shift"),
        "n_dispatch",
        "n_false_alarm",
    )


def status_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("risk_type", "status").agg(F.count(F.lit(1)).alias("n"))


def decision_totals(feedback: DataFrame) -> DataFrame:
    return (
        feedback.groupBy("decision")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("title", text.lookup(F.col("decision"), DECISION_TITLES))
    )


def open_closed(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("status") != "open").alias("n_closed")
    )


def feedback_labels(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Feedback with object, risk, label and weight; decisions without a label are dropped."""
    label = F.create_map(*[F.lit(x) for pair in DECISION_LABELS.items() for x in pair])[F.col("decision")]
    labelled = feedback.withColumn("y", label).filter(F.col("y").isNotNull())
    known = predictions.filter(F.col("object_id").isNotNull()).select(
        F.col("id").alias("prediction_id"), "object_id", "risk_type"
    )
    return labelled.join(_shuffled(known), "prediction_id").withColumn(
        "weight", F.when(F.col("y") == 0, NEGATIVE_WEIGHT).otherwise(POSITIVE_WEIGHT)
    )


def _labels_and_rows(
    feedback: DataFrame, predictions: DataFrame, panel: DataFrame, point_in_time: bool, period: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """(labelled decisions, panel rows, columns that lead from the first to the second)."""
    labels = feedback_labels(feedback, predictions).select(
        F.col("id").alias("feedback_id"), "object_id", "risk_type", "y", "weight", "created_at"
    )
    if not point_in_time:
        return labels, first_per_key(panel, ["object_id"], [F.desc("hour_ts")]), ["object_id"]
    # The panel is dense inside each period, so the newest row at or before a decision is the row of its own hour
    # or, past a period's end, that period's last row.
    segments = panel.groupBy("object_id", period).agg(F.min("hour_ts").alias("_from"), F.max("hour_ts").alias("_to"))
    hour = hour_timestamp(hour_number(F.col("created_at")))
    reached = (
        labels.select("feedback_id", "object_id", hour.alias("_hour"))
        .join(segments, "object_id")
        .filter(F.col("_hour") >= F.col("_from"))
        .groupBy("feedback_id")
        .agg(F.max(F.least("_hour", "_to")).alias("hour_ts"))
    )
    return labels.join(reached, "feedback_id"), panel, ["object_id", "hour_ts"]


def training_set(
    feedback: DataFrame, predictions: DataFrame, panel: DataFrame, point_in_time: bool = False, period: str = "period"
) -> DataFrame:
    """One row per labelled decision with the features of its object.

    By default the newest features, whatever the decision's age; point_in_time takes the newest hour at or before
    the decision instead. `period` names the panel's column of that kind (the stored dataset calls it year).
    """
    labels, rows, keys = _labels_and_rows(feedback, predictions, panel, point_in_time, period)
    return labels.join(rows, keys)


def weighted_training_set(
    feedback: DataFrame, predictions: DataFrame, panel: DataFrame, point_in_time: bool = False, period: str = "period",
    copies: int = COPIES,
) -> DataFrame:
    """The training set for a fit: (risk_type, y, weight, decisions and the panel's columns).

    Decisions on one object and hour with the same risk and label are equal rows. As many as `copies` stay rows of their
    own; more become `copies` rows that share them evenly. Each row has the number and the summed weight of its decisions,
    so every decision counts, while rows and their features do not grow with the decisions.
    """
    labels, rows, keys = _labels_and_rows(feedback, predictions, panel, point_in_time, period)
    equal = labels.groupBy(*keys, "risk_type", "y", "weight").agg(F.count(F.lit(1)).alias("_n"))
    equal = equal.withColumn("_rows", F.least("_n", F.lit(copies)))
    shared = equal.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    shared = shared.withColumn("decisions", F.expr("_n div _rows + if(_i < _n % _rows, 1, 0)"))
    return shared.withColumn("weight", F.col("weight") * F.col("decisions")).drop("_n", "_rows", "_i").join(rows, keys)
