"""Alarm rules, predictions, feedback, tickets, tree and screen queries, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.config import DECISION_TITLES, RISK_TITLES, RISKS
from undercroft.operators import alarm_risk, audit, feedback, hierarchy, marts, normalize, predictions
from undercroft.plans import alarm_store, dispatch_jobs, views
from undercroft.session import fresh_path
from undercroft.sources import documents, files
from undercroft.sources.tables import read_table
from workload.binding import CONFIG, Tables
from workload.oracles import case_of, rd
from workload.registry import query


def alarms(t: Tables):
    return marts.alarm_mart(t.events)


def channels(t: Tables):
    return normalize.clean_channels(t.channels)


def rule_predictions(t: Tables):
    return alarm_risk.score_alarms(alarms(t), channels(t), CONFIG)


@query(
    "alarm_risk_buckets",
    "SELECT object_id, risk_type, n_events, n_channels, n_pickets, channel_id, samples FROM o_buckets",
)
def alarm_risk_buckets(t: Tables):
    buckets = alarm_risk.alarm_risk_buckets(alarm_risk.recent_classified_alarms(alarms(t), channels(t), CONFIG))
    return buckets.withColumn("samples", F.array_join("samples", "; "))


@query("alarm_rule_predictions", "SELECT * FROM o_rule_preds")
def alarm_rule_predictions(t: Tables):
    return rule_predictions(t)


@query("alarm_rule_predictions_one_object", "SELECT * FROM o_rule_preds WHERE object_id = 3")
def alarm_rule_predictions_one_object(t: Tables):
    """The per-object job: it scores one object, as the service does on request."""
    wanted = t.objects.filter(F.col("id") == 3).select(F.col("id").alias("object_id"))
    return alarm_risk.score_alarms(alarms(t), channels(t), CONFIG, wanted)


_KEPT = "object_id, risk_type, probability, status, source, explanation"


@query(
    "replace_open",
    f"""SELECT {_KEPT} FROM b_predictions WHERE NOT (status = 'open' AND source = 'rules')
        UNION ALL SELECT {_KEPT} FROM o_rule_preds""",
)
def replace_open(t: Tables):
    return predictions.replace_open(t.predictions, rule_predictions(t)).select(*_KEPT.split(", "))


@query(
    "replace_open_all",
    f"""SELECT {_KEPT} FROM b_predictions WHERE status <> 'open' UNION ALL SELECT {_KEPT} FROM o_rule_preds""",
)
def replace_open_all(t: Tables):
    return predictions.replace_open(t.predictions, rule_predictions(t), "all").select(*_KEPT.split(", "))


@query(
    "replace_open_touched",
    f"""SELECT {_KEPT} FROM b_predictions
        WHERE NOT (status = 'open' AND source = 'rules' AND object_id IN (SELECT object_id FROM o_recent_objects))
        UNION ALL SELECT {_KEPT} FROM o_rule_preds WHERE object_id IN (SELECT object_id FROM o_recent_objects)""",
    extra={
        "o_recent_objects": """SELECT DISTINCT c.object_id FROM o_alarms a JOIN o_mart_channels c ON c.id = a.channel_id
            WHERE c.object_id IS NOT NULL AND a.event_ts >= (SELECT max(event_ts) FROM o_alarms) - INTERVAL 2 HOUR"""
    },
)
def replace_open_touched(t: Tables):
    """Only objects with an alarm in the last two hours are rescored."""
    mart = alarms(t)
    since = mart.agg(F.max("event_ts") - F.expr("INTERVAL 2 HOUR")).scalar()
    touched = (
        mart.filter(F.col("event_ts") >= since)
        .join(channels(t).select(F.col("id").alias("channel_id"), "object_id"), "channel_id")
        .filter(F.col("object_id").isNotNull())
        .select("object_id")
        .distinct()
    )
    created = alarm_risk.score_alarms(mart, channels(t), CONFIG, touched)
    return predictions.replace_open(t.predictions, created, "rules", touched).select(*_KEPT.split(", "))


def decisions(t: Tables):
    """Feedback read as a batch of decisions, one in nine of them illegal, some on unknown predictions."""
    return t.feedback.select(
        F.when(F.col("id") % 11 == 0, F.col("prediction_id") + 10_000_000_000)
        .otherwise(F.col("prediction_id"))
        .alias("prediction_id"),
        F.when(F.col("id") % 9 == 0, "ignore").otherwise(F.col("decision")).alias("decision"),
        F.when(F.col("id") % 2 == 0, F.col("reason")).alias("reason"),
        "user_login",
        F.col("created_at").alias("decided_at"),
    )


_DECISIONS = {
    "o_decisions": """
        SELECT CASE WHEN id % 11 = 0 THEN prediction_id + 10000000000 ELSE prediction_id END AS prediction_id,
               CASE WHEN id % 9 = 0 THEN 'ignore' ELSE decision END AS decision,
               CASE WHEN id % 2 = 0 THEN reason END AS reason, user_login, created_at AS decided_at
        FROM b_feedback""",
    "o_accepted": """
        SELECT * FROM o_decisions WHERE decision <> 'ignore' AND prediction_id IN (SELECT id FROM b_predictions)""",
}


@query(
    "apply_decisions",
    """SELECT p.id, p.risk_type, coalesce(d.decision, p.status) AS status
       FROM b_predictions p LEFT JOIN (
           SELECT prediction_id, decision,
                  row_number() OVER (PARTITION BY prediction_id ORDER BY decided_at DESC, decision) AS rn
           FROM o_accepted) d ON d.prediction_id = p.id AND d.rn = 1""",
    extra=_DECISIONS,
)
def apply_decisions(t: Tables):
    accepted, _ = feedback.split_decisions(decisions(t), t.predictions)
    return feedback.apply_decisions(t.predictions, accepted).select("id", "risk_type", "status")


@query(
    "rejected_decisions",
    """SELECT prediction_id, decision, CASE WHEN decision = 'ignore' THEN 'illegal decision'
              ELSE 'unknown prediction' END AS problem
       FROM o_decisions WHERE decision = 'ignore' OR prediction_id NOT IN (SELECT id FROM b_predictions)""",
    extra=_DECISIONS,
)
def rejected_decisions(t: Tables):
    return feedback.split_decisions(decisions(t), t.predictions)[1].select("prediction_id", "decision", "problem")


@query(
    "feedback_append",
    "SELECT prediction_id, decision, reason, user_login, decided_at AS created_at FROM o_accepted",
    extra=_DECISIONS,
)
def feedback_append(t: Tables):
    return feedback.feedback_rows(feedback.split_decisions(decisions(t), t.predictions)[0])


_TICKETS = f"""
    SELECT d.prediction_id, p.object_id,
           {case_of('p.risk_type', RISK_TITLES)} || ': объект ' || p.object_id AS title,
           coalesce(d.reason, p.recommendation, p.explanation) AS body, 'draft' AS status
    FROM o_accepted d JOIN b_predictions p ON p.id = d.prediction_id WHERE d.decision = 'dispatch'"""


def drafts(t: Tables):
    accepted, _ = feedback.split_decisions(decisions(t), t.predictions)
    return feedback.ticket_drafts(accepted.filter(F.col("decision") == "dispatch"), t.predictions)


@query("ticket_drafts", _TICKETS, extra=_DECISIONS)
def ticket_drafts(t: Tables):
    return drafts(t)


def tickets(t: Tables):
    """Predictions that were dispatched, seen as stored tickets."""
    return t.predictions.select(
        "id", F.col("id").alias("prediction_id"), "object_id", F.col("explanation").alias("title"),
        F.col("recommendation").alias("body"),
        F.when(F.col("status") == "open", "draft").otherwise("sent").alias("status"),
        F.lit(None).cast("string").alias("external_id"), "created_at",
    )


_O_TICKETS = {
    "o_tickets": "SELECT id, CASE WHEN status = 'open' THEN 'draft' ELSE 'sent' END AS status FROM b_predictions"
}


@query(
    "send_newest_ticket",
    """SELECT id, CASE WHEN id = m THEN 'sent' ELSE status END AS status,
              CASE WHEN id = m THEN 'ODS-' || printf('%06d', id)
              END AS external_id
       FROM o_tickets, (SELECT max(id) AS m FROM o_tickets WHERE status = 'draft') x""",
    extra=_O_TICKETS,
)
def send_newest_ticket(t: Tables):
    return feedback.send_tickets(tickets(t)).select("id", "status", "external_id")


@query(
    "send_drafts",
    """SELECT id, 'sent' AS status,
              CASE WHEN status = 'draft'
                   THEN 'ODS-' || printf('%06d', id)
              END AS external_id FROM o_tickets""",
    extra=_O_TICKETS,
)
def send_drafts(t: Tables):
    rows = tickets(t)
    return feedback.send_tickets(rows, rows.filter(F.col("status") == "draft").select("id")).select(
        "id", "status", "external_id"
    )


@query("ticket_list", "SELECT id, status FROM o_tickets WHERE status = 'draft' ORDER BY id DESC LIMIT 50", extra=_O_TICKETS)
def ticket_list(t: Tables):
    return views.ticket_list(tickets(t), "draft").select("id", "status")


@query("feedback_counts", "SELECT * FROM o_feedback_n")
def feedback_counts(t: Tables):
    return feedback.decision_counts(t.feedback, t.predictions)


@query("calibrate", "SELECT * FROM o_calibrated")
def calibrate(t: Tables):
    return feedback.calibrate(feedback.base_thresholds(t.predictions), t.feedback, t.predictions)


@query(
    "effective_thresholds",
    """SELECT b.risk_type, coalesce(c.threshold, b.threshold) AS threshold
       FROM (SELECT risk_type, CASE WHEN risk_type = 'flood' THEN 0.42::DOUBLE ELSE threshold END AS threshold
             FROM o_base_thr) b
       LEFT JOIN (SELECT * FROM o_calibrated WHERE risk_type IN ('fire', 'failure')) c ON c.risk_type = b.risk_type""",
)
def effective_thresholds(t: Tables):
    """Flood has a model threshold, fire and failure are calibrated, intrusion falls back to the default."""
    known = t.predictions.filter(F.col("risk_type") == "flood").select("risk_type", F.lit(0.42).alias("threshold"))
    base = feedback.base_thresholds(t.predictions, known.distinct())
    stored = calibrate(t).filter(F.col("risk_type").isin("fire", "failure"))
    return feedback.effective_thresholds(base, stored)


@query(
    "feedback_status_counts",
    "SELECT risk_type, status, count(*) AS n FROM b_predictions GROUP BY ALL",
)
def status_counts(t: Tables):
    return feedback.status_counts(t.predictions)


@query(
    "feedback_stats",
    f"SELECT decision, count(*) AS n, {case_of('decision', DECISION_TITLES, 'decision')} AS title "
    "FROM b_feedback GROUP BY decision",
)
def feedback_stats(t: Tables):
    return feedback.decision_totals(t.feedback)


@query(
    "open_closed",
    "SELECT count_if(status = 'open') AS n_open, count_if(status <> 'open') AS n_closed FROM b_predictions",
)
def open_closed(t: Tables):
    return feedback.open_closed(t.predictions)


# ---- tree and screens -------------------------------------------------------------------------------------------------

_RISK_MAP = """
    SELECT object_id, string_agg(risk_type || '=' || n, ',' ORDER BY risk_type) AS open_risks,
           max(p) AS max_probability
    FROM (SELECT object_id, risk_type, count(*) AS n, max(probability) AS p
          FROM b_predictions WHERE status = 'open' AND object_id IS NOT NULL GROUP BY ALL) r GROUP BY object_id"""


def _map_text(column: str = "open_risks"):
    pairs = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query("risk_map", _RISK_MAP)
def risk_map(t: Tables):
    return views.risk_map(t.predictions).withColumn("open_risks", _map_text())


@query(
    "object_list",
    f"""SELECT o.id, o.level, o.parent_id, o.kind, o.name, coalesce(r.open_risks, '') AS open_risks, r.max_probability
        FROM (SELECT * FROM b_objects ORDER BY level, id LIMIT 200) o LEFT JOIN ({_RISK_MAP}) r ON r.object_id = o.id""",
)
def object_list(t: Tables):
    return views.object_list(t.objects, t.predictions, limit=200).withColumn("open_risks", _map_text())


@query(
    "object_list_all",
    f"""SELECT o.id, o.level, o.parent_id, o.kind, o.name, coalesce(r.open_risks, '') AS open_risks, r.max_probability
        FROM b_objects o LEFT JOIN ({_RISK_MAP}) r ON r.object_id = o.id""",
)
def object_list_all(t: Tables):
    return views.object_list(t.objects, t.predictions).withColumn("open_risks", _map_text())


@query(
    "object_search",
    "SELECT id, level, parent_id, kind, name FROM b_objects WHERE kind = 'guardObject' AND name ILIKE '%R#00000001%' "
    "ORDER BY level, id LIMIT 200",
)
def object_search(t: Tables):
    return views.object_list(t.objects, t.predictions, kind="guardObject", q="R#00000001", limit=200, with_risks=False)


@query(
    "ancestors",
    """SELECT c.id AS object_id, 1 AS distance, p.id AS ancestor_id, p.kind, p.name, p.level,
              CAST(CASE WHEN g.id IS NULL THEN 1 ELSE 2 END AS INTEGER) AS position
       FROM b_objects c JOIN b_objects p ON p.id = c.parent_id LEFT JOIN b_objects g ON g.id = p.parent_id
       UNION ALL
       SELECT c.id, 2, g.id, g.kind, g.name, g.level, 1
       FROM b_objects c JOIN b_objects p ON p.id = c.parent_id JOIN b_objects g ON g.id = p.parent_id""",
)
def ancestors(t: Tables):
    return hierarchy.root_first(hierarchy.ancestors(t.objects))


@query(
    "children",
    "SELECT parent_id AS object_id, id AS child_id, kind, name, level FROM b_objects WHERE parent_id IS NOT NULL",
)
def children(t: Tables):
    return hierarchy.children(t.objects)


@query("picket_profile", "SELECT * FROM o_pickets")
def picket_profile(t: Tables):
    return hierarchy.picket_profile(channels(t), CONFIG).withColumn("sensor_types", F.array_join("sensor_types", ","))


@query(
    "picket_extent",
    """SELECT object_id, min(picket_no) FILTER (WHERE picket <> 'без пикета') AS picket_min,
              max(picket_no) FILTER (WHERE picket <> 'без пикета') AS picket_max,
              count_if(picket <> 'без пикета') AS n_pickets,
              CAST(coalesce(sum(n_channels) FILTER (WHERE picket = 'без пикета'), 0) AS BIGINT) AS n_outside
       FROM o_pickets GROUP BY object_id""",
)
def picket_extent(t: Tables):
    return hierarchy.picket_extent(hierarchy.picket_profile(channels(t), CONFIG), CONFIG)


def named_alarms(t: Tables):
    return views.event_list(alarms(t), channels(t), t.objects, CONFIG, limit=None)


_ACTIVE = """SELECT DISTINCT object_id, picket, risk FROM o_named_alarms
             WHERE risk IS NOT NULL AND picket IS NOT NULL AND picket <> ''"""


@query("active_risks", _ACTIVE)
def active_risks(t: Tables):
    return hierarchy.active_risks(named_alarms(t))


@query(
    "picket_priority",
    f"""SELECT object_id, picket, picket_no, n_channels, is_hot FROM (
            SELECT p.*, h.picket IS NOT NULL AS is_hot,
                   row_number() OVER (PARTITION BY p.object_id
                                      ORDER BY h.picket IS NULL, coalesce(p.picket_no, 0), p.picket) AS rn
            FROM o_pickets p
            LEFT JOIN (SELECT DISTINCT object_id, picket FROM ({_ACTIVE}) a WHERE risk = 'fire') h
              ON h.object_id = p.object_id AND h.picket = p.picket
            WHERE p.picket <> 'без пикета') r WHERE is_hot OR rn <= 3""",
)
def picket_priority(t: Tables):
    """Three pickets are shown instead of 36, so that the cut is exercised; only fire counts as a risk here."""
    hot = active_risks(t).filter(F.col("risk") == "fire")
    out = hierarchy.picket_priority(hierarchy.picket_profile(channels(t), CONFIG), hot, CONFIG, shown=3)
    return out.select("object_id", "picket", "picket_no", "n_channels", "is_hot")


@query("events_list", "SELECT * FROM o_named_alarms")
def events_list(t: Tables):
    return named_alarms(t)


@query("events_newest", "SELECT * FROM o_named_alarms ORDER BY event_ts DESC, event_id DESC LIMIT 50")
def events_newest(t: Tables):
    return views.event_list(alarms(t), channels(t), t.objects, CONFIG)


@query(
    "events_filtered",
    """SELECT * FROM o_named_alarms WHERE object_id = 4 AND sensor_type = 'pump'
           AND event_ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 12:00:00'
       ORDER BY event_ts DESC, event_id DESC LIMIT 50""",
)
def events_filtered(t: Tables):
    import datetime as dt

    return views.event_list(
        alarms(t), channels(t), t.objects, CONFIG, object_id=4, sensor_type="pump",
        date_from=dt.datetime(2024, 1, 5), date_to=dt.datetime(2024, 1, 25, 12),
    )


@query(
    "object_channels",
    "SELECT id, sensor_type, system_type, name, picket, tag FROM o_mart_channels WHERE object_id = 4",
)
def object_channels(t: Tables):
    return views.object_channels(channels(t), 4)


@query(
    "alarm_journal",
    """SELECT event_id, a.event_ts AS ts, c.object_id, c.name AS channel, c.sensor_type,
              coalesce(nullif(value_cat, ''), value_raw) AS value
       FROM o_alarms a LEFT JOIN b_channels c ON c.id = a.channel_id
       ORDER BY event_ts DESC, event_id DESC LIMIT 20""",
)
def alarm_journal(t: Tables):
    return views.alarm_journal(alarms(t), channels(t))


@query(
    "alarm_templates",
    """SELECT event_id, channel_id, risk_type FROM (
           SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY event_ts DESC, event_id DESC) AS rn
           FROM (SELECT n.*, n.risk AS risk_type FROM o_named_alarms n JOIN b_channels c ON c.id = n.channel_id
                 WHERE n.risk IS NOT NULL) r) q
       WHERE rn = 1 ORDER BY event_ts DESC, event_id DESC LIMIT 40""",
)
def alarm_templates(t: Tables):
    return alarm_risk.alarm_templates(alarms(t), channels(t), CONFIG, 40).select("event_id", "channel_id", "risk_type")


@query(
    "stream_status",
    """SELECT count(*) AS alarms, max(event_ts) - INTERVAL 24 HOUR AS data_from, max(event_ts) AS data_to,
              300 AS slo_seconds FROM o_alarms""",
)
def stream_status(t: Tables):
    return alarm_risk.stream_status(alarms(t), CONFIG)


_NAMED = f"""
    SELECT p.id, p.object_id, o.name AS object_name, p.risk_type, {case_of('p.risk_type', RISK_TITLES)} AS risk_title,
           p.probability, p.status, p.source, p.created_at
    FROM b_predictions p LEFT JOIN b_objects o ON o.id = p.object_id"""
_NAMED_COLUMNS = ("id", "object_id", "object_name", "risk_type", "risk_title", "probability", "status", "source", "created_at")


@query(
    "dashboard",
    f"""SELECT count(*) AS open_total, count(DISTINCT object_id) AS objects_at_risk,
               {", ".join(f"count_if(risk_type = '{r}') AS open_{r}" for r in RISKS)},
               any_value(t) - INTERVAL 24 HOUR AS data_from, any_value(t) AS data_to,
               CAST(any_value(month(t)) AS INTEGER) AS month, any_value(month(t)) BETWEEN 3 AND 8 AS flood_season,
               any_value(month(t)) IN (11, 12, 1, 2) AS heating_season, 300 AS stream_slo_seconds
        FROM b_predictions, (SELECT max(event_ts) AS t FROM o_alarms) a WHERE status = 'open'""",
)
def dashboard(t: Tables):
    return views.dashboard_totals(t.predictions, alarms(t), CONFIG)


@query(
    "dashboard_top",
    f"""SELECT *, probability >= 0.8 AS is_critical FROM ({_NAMED}) n WHERE status = 'open'
        ORDER BY probability DESC, id DESC LIMIT 15""",
)
def dashboard_top(t: Tables):
    return views.dashboard_top(t.predictions, t.objects).select(*_NAMED_COLUMNS, "is_critical")


@query(
    "predictions_list",
    f"SELECT * FROM ({_NAMED}) n WHERE status = 'open' AND risk_type = 'flood' AND source = 'model' "
    "ORDER BY probability DESC, id DESC LIMIT 100",
)
def predictions_list(t: Tables):
    return views.prediction_list(t.predictions, t.objects, risk="flood", source="model").select(*_NAMED_COLUMNS)


@query("predictions_named", _NAMED)
def predictions_named(t: Tables):
    """Every prediction with its object's name and risk title, whatever its status."""
    rows = predictions.filter_predictions(t.predictions, status="all")
    return predictions.with_object_names(rows, t.objects).select(*_NAMED_COLUMNS)


@query(
    "feedback_history",
    f"""SELECT f.prediction_id, p.risk_type, p.status, f.id, f.decision,
               {case_of('f.decision', DECISION_TITLES)} AS decision_title, f.reason, f.user_login, f.created_at
        FROM b_feedback f JOIN b_predictions p ON p.id = f.prediction_id""",
)
def feedback_history(t: Tables):
    return views.feedback_history(t.predictions, t.feedback)


@query(
    "model_table",
    f"""SELECT b.risk_type, {case_of('b.risk_type', RISK_TITLES)} AS title, m.precision, m.recall, m.pr_auc,
               m.threshold, c.threshold AS calibrated_threshold, c.n_dispatch, c.n_false_alarm
        FROM o_base_thr b JOIN o_calibrated c ON c.risk_type = b.risk_type
        LEFT JOIN (SELECT risk, {rd('avg(y)', 'pr_auc')}, {rd('avg(hit)', 'precision')},
                          {rd('avg(hit)', 'recall')}, {rd('min(probability)', 'threshold')}
                   FROM (SELECT risk_type AS risk, probability, CAST(status = 'dispatch' AS INTEGER) AS y,
                                CAST(probability >= 0.5 AS INTEGER) AS hit FROM b_predictions) p
                   WHERE risk <> 'intrusion' GROUP BY risk) m ON m.risk = b.risk_type""",
)
def model_table(t: Tables):
    """Stored predictions stand in for measured metrics; intrusion has none and must still be listed."""
    hit = (F.col("probability") >= 0.5).cast("int")
    metrics = (
        t.predictions.filter(F.col("risk_type") != "intrusion")
        .groupBy(F.col("risk_type").alias("risk"))
        .agg(
            F.avg((F.col("status") == "dispatch").cast("int")).alias("pr_auc"),
            F.avg(hit).alias("precision"), F.avg(hit).alias("recall"), F.min("probability").alias("threshold"),
        )
    )
    calibrated = calibrate(t)
    effective = feedback.effective_thresholds(feedback.base_thresholds(t.predictions), calibrated)
    return views.model_table(metrics, effective, calibrated)


# ---- files ------------------------------------------------------------------------------------------------------------


@query("journal_csv", "SELECT * FROM o_norm")
def journal_csv(t: Tables):
    """The raw journal written as CSV files under the journal's own header, read back and normalised."""
    from undercroft.schemas import JOURNAL_HEADER

    path = fresh_path(t.spark, "journal-csv")
    ours = {v: k for k, v in JOURNAL_HEADER.items()}
    raw = t.journal_raw.select(*[F.col(c).alias(ours[c]) for c in t.journal_raw.columns])
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    raw.write.options(header="true", **keep).csv(path)
    _, rows = files.read_kind(t.spark, [f.path for f in files.list_files(t.spark, path)], "journal")
    return normalize.normalize_events(rows.drop("year"))


@query(
    "prediction_export",
    f"""SELECT CAST(id AS VARCHAR) AS id, coalesce(object_name, CAST(object_id AS VARCHAR), '') AS object,
               risk_title AS risk, printf('%.3f', probability) AS probability, status, source, '24' AS horizon
        FROM ({_NAMED}) n""",
)
def prediction_export(t: Tables):
    """Every prediction exported and the file read back as text."""
    path = fresh_path(t.spark, "export")
    documents.write_export(predictions.with_object_names(t.predictions, t.objects), path)
    return t.spark.read.option("header", "true").option("sep", ";").option("escape", '"').csv(path)


@query(
    "audit_log",
    """SELECT user_login, 'prediction.decision' AS action,
              '{"prediction_id":' || prediction_id || ',"decision":"' || decision || '"}' AS details,
              decided_at AS created_at FROM o_accepted""",
    extra=_DECISIONS,
)
def audit_log(t: Tables):
    accepted, _ = feedback.split_decisions(decisions(t), t.predictions)
    rows = audit.audit_rows(
        accepted, "prediction.decision", F.col("user_login"), F.col("decided_at"), "prediction_id", "decision"
    )
    return rows.drop("id")


@query(
    "object_card",
    """SELECT o.id, o.level, o.parent_id, o.kind, o.name,
              (SELECT count(*) FROM o_mart_channels WHERE object_id = 4) AS n_channels,
              (SELECT count(*) FROM o_pickets WHERE object_id = 4) AS n_pickets
       FROM b_objects o WHERE o.id = 4""",
)
def object_card(t: Tables):
    return views.object_card(t.objects, channels(t), t.predictions, 4, CONFIG)["object"]()


@query("object_card_pickets", "SELECT * FROM o_pickets WHERE object_id = 4")
def object_card_pickets(t: Tables):
    pickets = views.object_card(t.objects, channels(t), t.predictions, 4, CONFIG)["pickets"]()
    return pickets.withColumn("sensor_types", F.array_join("sensor_types", ","))


@query("object_card_predictions", f"SELECT * FROM ({_NAMED}) n WHERE object_id = 4 AND status = 'open'")
def object_card_predictions(t: Tables):
    rows = views.object_card(t.objects, channels(t), t.predictions, 4, CONFIG)["predictions"]()
    return rows.select(*_NAMED_COLUMNS)


@query("object_card_ancestors", """
    SELECT c.id AS object_id, 1 AS distance, p.id AS ancestor_id, p.kind, p.name, p.level, 2 AS position
    FROM b_objects c JOIN b_objects p ON p.id = c.parent_id WHERE c.id = 4
    UNION ALL
    SELECT c.id, 2, g.id, g.kind, g.name, g.level, 1
    FROM b_objects c JOIN b_objects p ON p.id = c.parent_id JOIN b_objects g ON g.id = p.parent_id WHERE c.id = 4""")
def object_card_ancestors(t: Tables):
    return views.object_card(t.objects, channels(t), t.predictions, 4, CONFIG)["ancestors"]()


@query(
    "object_card_children",
    "SELECT parent_id AS object_id, id AS child_id FROM b_objects WHERE parent_id = (SELECT min(parent_id) FROM b_objects)",
)
def object_card_children(t: Tables):
    """The children on the card of the first object that has any."""
    first = t.objects.agg(F.min("parent_id")).first()[0]
    rows = views.object_card(t.objects, channels(t), t.predictions, first, CONFIG)["children"]()
    return rows.select("object_id", "child_id")


@query(
    "decision_job",
    """SELECT p.id, p.risk_type, coalesce(d.decision, p.status) AS status,
              (SELECT count(*) FROM o_accepted) AS n_feedback, (SELECT count(*) FROM o_accepted) AS n_audit
       FROM b_predictions p LEFT JOIN (
           SELECT prediction_id, decision,
                  row_number() OVER (PARTITION BY prediction_id ORDER BY decided_at DESC, decision) AS rn
           FROM o_accepted) d ON d.prediction_id = p.id AND d.rn = 1""",
    extra=_DECISIONS,
)
def decision_job(t: Tables):
    """The job over written tables: predictions replaced, feedback and audit extended."""
    house = fresh_path(t.spark, "house")
    t.predictions.write.parquet(f"{house}/predictions")
    dispatch_jobs.decision_job(t.spark, house, decisions(t))
    rows = read_table(t.spark, f"{house}/predictions").select("id", "risk_type", "status")
    counts = [t.spark.read.parquet(f"{house}/{n}").agg(F.count(F.lit(1))).scalar().alias(f"n_{n}") for n in ("feedback", "audit")]
    return rows.select("*", *counts)


@query(
    "rule_job",
    f"""SELECT {_KEPT} FROM b_predictions WHERE NOT (status = 'open' AND source = 'rules')
        UNION ALL SELECT {_KEPT} FROM o_rule_preds""",
)
def rule_job(t: Tables):
    """The job over a stored mart and a stored prediction table."""
    house = fresh_path(t.spark, "house")
    t.predictions.write.parquet(f"{house}/predictions")
    alarm_store.load_alarms(alarms(t), house)
    dispatch_jobs.rule_job(t.spark, house, channels(t), CONFIG, F.lit("2024-01-01").cast("timestamp_ntz"))
    return read_table(t.spark, f"{house}/predictions").select(*_KEPT.split(", "))


@query("calibration_job", "SELECT * FROM o_calibrated")
def calibration_job(t: Tables):
    house = fresh_path(t.spark, "house")
    t.predictions.write.parquet(f"{house}/predictions")
    t.feedback.write.parquet(f"{house}/feedback")
    dispatch_jobs.calibration_job(t.spark, house)
    return read_table(t.spark, f"{house}/calibration")
