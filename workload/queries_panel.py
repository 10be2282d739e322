"""Panel stages, panel checks, baseline scores and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.config import (
    FEATURE_COLUMNS,
    LABEL_COLUMNS,
    PANEL_COLUMNS,
    RECOMMENDATIONS,
    RISK_TITLES,
    RISKS,
)
from undercroft.functions.calendar import hour_timestamp
from undercroft.functions.scores import persist_score, rule_score
from undercroft.operators import curve, feedback, hourly, marts, normalize, predictions, profiling
from undercroft.operators.tallies import channel_hour_tallies, typed_channel_hours
from undercroft.plans import alarm_store, jobs, panel
from undercroft.session import fresh_path, stage
from undercroft.sources import documents, tables
from workload.binding import CONFIG, Tables
from workload.oracles import PANEL_HOURLY, rd
from workload.queries_events import doubled_events
from workload.registry import query

DOUBLES = (
    "month_sin", "month_cos", "events_per_channel_24h", "temp_mean_6h", "temp_mean_24h", "temp_max_6h",
    "temp_max_24h", "temp_min_24h", "temp_trend", "gas_mean_24h", "gas_max_6h", "gas_max_24h", "temp_out", "precip",
    "humidity",
)


def columns_sql(names) -> str:
    return ", ".join(rd(n, n) if n in DOUBLES else n for n in names)


def full_panel(t: Tables):
    return panel.build_panel(t.events, t.channels, t.weather, CONFIG)


def marked(t: Tables):
    typed = typed_channel_hours(channel_hour_tallies(t.events, CONFIG), panel.panel_channels(t.channels), CONFIG)
    return hourly.mark_channel_hours(typed, CONFIG)


def at_hour(df, name="hour_ts"):
    return df.withColumn(name, hour_timestamp(F.col("hour_no"))).drop("hour_no")


@query("object_caps", "SELECT * FROM o_caps")
def object_caps(t: Tables):
    return hourly.object_profile(panel.panel_channels(t.channels), CONFIG)


@query("noisy_channels", "SELECT channel_id, noisy_fire, noisy_flood FROM o_noisy")
def noisy_channels(t: Tables):
    return hourly.noisy_channels(marked(t), CONFIG).drop("period")


@query(
    "channel_failures",
    "SELECT channel_id, h AS hour_ts, count_if(failure) AS n_failure FROM o_flag GROUP BY channel_id, h",
)
def channel_failures(t: Tables):
    return at_hour(marked(t).select("channel_id", "hour_no", "n_failure"))


@query("new_failures", "SELECT channel_id, object_id, h AS hour_ts FROM o_newfail")
def new_failures(t: Tables):
    return at_hour(hourly.new_failures(marked(t)).select("channel_id", "object_id", "hour_no"))


_HOURLY = ", ".join(PANEL_HOURLY)


@query(
    "panel_hourly",
    f"""SELECT object_id, h AS hour_ts, {_HOURLY}, {rd('temp_mean', 'temp_mean')}, temp_max, temp_min,
               {rd('gas_mean', 'gas_mean')}, gas_max, guard_state FROM o_hour""",
)
def panel_hourly(t: Tables):
    return at_hour(panel.sparse_object_hours(t.events, t.channels, CONFIG).drop("period"))


@query(
    "live_objects",
    "SELECT object_id, CAST(sum(n_events) AS BIGINT) AS n_events FROM o_hour GROUP BY object_id HAVING sum(n_events) >= 20",
)
def live_objects(t: Tables):
    return hourly.live_objects(panel.sparse_object_hours(t.events, t.channels, CONFIG), CONFIG).drop("period")


@query(
    "period_bounds",
    "SELECT 2024 AS period, min(h) AS first_hour, max(h) AS last_hour FROM o_hour",
)
def period_bounds(t: Tables):
    return hourly.period_bounds(t.events, t.channels).select(
        "period",
        hour_timestamp(F.col("hour_first")).alias("first_hour"),
        hour_timestamp(F.col("hour_last")).alias("last_hour"),
    )


@query(
    "dense_grid",
    "SELECT g.object_id, g.h AS hour_ts, "
    + ", ".join(f"CAST(coalesce(x.{c}, 0) AS BIGINT) AS {c}" for c in PANEL_HOURLY)
    + """, x.temp_max, x.guard_state
       FROM o_grid g LEFT JOIN o_hour x ON x.object_id = g.object_id AND x.h = g.h""",
)
def dense_grid(t: Tables):
    return panel.dense_grid(t.events, t.channels, CONFIG).select(
        "object_id", "hour_ts", *PANEL_HOURLY, "temp_max", "guard_state"
    )


@query("panel_full", f"SELECT {columns_sql(PANEL_COLUMNS)} FROM o_panel")
def panel_full(t: Tables):
    return full_panel(t).select(*PANEL_COLUMNS)


@query("panel_features", f"SELECT object_id, hour_ts, {columns_sql(FEATURE_COLUMNS[16:])} FROM o_panel")
def panel_features(t: Tables):
    return full_panel(t).select("object_id", "hour_ts", *FEATURE_COLUMNS[16:])


@query("panel_labels", f"SELECT object_id, hour_ts, {', '.join(LABEL_COLUMNS)} FROM o_panel")
def panel_labels(t: Tables):
    return full_panel(t).select("object_id", "hour_ts", *LABEL_COLUMNS)


@query(
    "panel_without_weather",
    f"SELECT object_id, hour_ts, ev_24h, CAST(NULL AS DOUBLE) AS temp_out, CAST(NULL AS DOUBLE) AS precip, "
    "CAST(NULL AS DOUBLE) AS humidity FROM o_panel",
)
def panel_without_weather(t: Tables):
    return panel.build_panel(t.events, t.channels, None, CONFIG).select(
        "object_id", "hour_ts", "ev_24h", "temp_out", "precip", "humidity"
    )


@query("latest_rows", f"SELECT {columns_sql(PANEL_COLUMNS)} FROM o_latest")
def latest_rows(t: Tables):
    return predictions.latest_rows(full_panel(t)).select(*PANEL_COLUMNS)


# ---- checks of the panel ----------------------------------------------------------------------------------------------


@query(
    "fill_rates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS n_filled, count(*) AS n_rows, "
        f"{rd(f'CAST(count({c}) AS DOUBLE) / count(*)', 'fill_rate')} FROM o_panel"
        for c in profiling.KEY_COLUMNS
    ),
)
def fill_rates(t: Tables):
    return profiling.fill_rates(full_panel(t))


@query(
    "label_rates",
    " UNION ALL ".join(
        f"SELECT '{r}' AS risk, {rd(f'avg(y_{r})', 'rate')}, CAST(sum(y_{r}) AS BIGINT) AS positives, "
        f"max(y_{r}_cnt) AS max_count FROM o_panel"
        for r in RISKS
    ),
)
def label_rates(t: Tables):
    return profiling.label_rates(full_panel(t))


@query(
    "class_means",
    " UNION ALL ".join(
        f"SELECT '{r}' AS risk, '{c}' AS feature, "
        f"{rd(f'coalesce(avg({c}) FILTER (WHERE y_{r} = 0), 0)', 'mean_negative')}, "
        f"{rd(f'coalesce(avg({c}) FILTER (WHERE y_{r} = 1), 0)', 'mean_positive')} FROM o_panel"
        for r in RISKS
        for c in (f"{r}_24h", f"{r}_6h", "al_24h", "ev_24h")
    ),
)
def class_means(t: Tables):
    return profiling.class_means(full_panel(t))


@query(
    "leak_check",
    " UNION ALL ".join(
        f"SELECT '{r}' AS risk, {rd(f'avg(y_{r}) FILTER (WHERE {r}_1h > 0)', 'p_event_now')}, "
        f"{rd(f'avg(y_{r}) FILTER (WHERE {r}_1h = 0)', 'p_quiet_now')} FROM o_panel"
        for r in RISKS
    ),
)
def leak_check(t: Tables):
    return profiling.leak_check(full_panel(t))


def _examples_sql(risk: str) -> str:
    names = ("object_id", "hour_ts", *profiling.EXAMPLE_COLUMNS[risk], f"y_{risk}", f"y_{risk}_cnt")
    return (
        f"SELECT {columns_sql(names)} FROM (SELECT * FROM o_panel WHERE y_{risk} = 1 "
        f"ORDER BY y_{risk}_cnt DESC, object_id, hour_ts LIMIT 3) e"
    )


@query("positive_examples_fire", _examples_sql("fire"))
def positive_examples_fire(t: Tables):
    return profiling.positive_examples(full_panel(t), "fire")


@query("positive_examples_flood", _examples_sql("flood"))
def positive_examples_flood(t: Tables):
    return profiling.positive_examples(full_panel(t), "flood")


@query(
    "build_stats",
    "SELECT period, count(*) AS n_rows, count(DISTINCT object_id) AS n_objects, "
    + ", ".join(f"CAST(sum(y_{r}) AS BIGINT) AS pos_{r}" for r in RISKS)
    + ", "
    + ", ".join(f"round(CAST(sum(y_{r}) AS DOUBLE) / count(*), 5) AS rate_{r}" for r in RISKS)
    + " FROM o_panel GROUP BY period",
)
def build_stats(t: Tables):
    return profiling.build_stats(full_panel(t))


# ---- scores and their evaluation --------------------------------------------------------------------------------------


@query("persist_scores", f"SELECT risk, object_id, hour_ts, y, {rd('score', 'score')} FROM o_scores WHERE method = 'persist'")
def persist_scores(t: Tables):
    return curve.long_scores(full_panel(t), ["persist"]).drop("split", "method")


@query("rule_scores", "SELECT risk, object_id, hour_ts, y, score FROM o_scores WHERE method = 'rules'")
def rule_scores(t: Tables):
    return curve.long_scores(full_panel(t), ["rules"]).drop("split", "method")


def scores(t: Tables):
    return curve.long_scores(full_panel(t))


@query(
    "pr_curve",
    f"""SELECT split, method, risk, {rd('threshold', 'threshold')}, pos, tp, predicted, n_pos, n_rows,
               {rd('precision', 'precision')}, {rd('recall', 'recall')} FROM o_pr""",
)
def pr_curve(t: Tables):
    return curve.pr_curve(scores(t))


@query(
    "pr_curve_events",
    f"""SELECT kind, {rd('threshold', 'threshold')}, CAST(tp AS BIGINT) AS tp, CAST(predicted AS BIGINT) AS predicted,
               {rd('CAST(tp AS DOUBLE) / predicted', 'precision')}
        FROM (SELECT kind, threshold, sum(pos) OVER w AS tp, sum(n) OVER w AS predicted
              FROM (SELECT user_id % 2 AS kind, value / (value + 3) AS threshold,
                           count_if(event_type = 'error') AS pos, count(*) AS n
                    FROM events GROUP BY ALL) c
              WINDOW w AS (PARTITION BY kind ORDER BY threshold DESC)) r""",
)
def pr_curve_events(t: Tables):
    """The curve over raw events: nearly as many distinct scores as rows."""
    raw = t.base("events").select(
        (F.col("user_id") % 2).alias("kind"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        (F.col("value") / (F.col("value") + 3)).alias("score"),
    )
    return curve.pr_curve(raw, ["kind"]).select("kind", "threshold", "tp", "predicted", "precision")


@query("average_precision", f"SELECT split, method, risk, {rd('pr_auc', 'pr_auc')} FROM o_ap")
def average_precision(t: Tables):
    return curve.average_precision(curve.pr_curve(scores(t)))


@query("choose_threshold", f"SELECT split, method, risk, {rd('threshold', 'threshold')} FROM o_thr")
def choose_threshold(t: Tables):
    return curve.choose_thresholds(curve.pr_curve(scores(t)), CONFIG)


def evaluated(t: Tables):
    long = scores(t)
    points = curve.pr_curve(long)
    return curve.evaluate(long, points, curve.fixed_thresholds(curve.choose_thresholds(points, CONFIG)))


_METRICS = ", ".join(rd(c, c) for c in ("threshold", "precision", "recall", "pr_auc"))


@query(
    "metrics_at_threshold",
    f"SELECT split, method, risk, positives_pred, positives_true, n, {_METRICS} FROM o_metrics",
)
def metrics_at_threshold(t: Tables):
    return evaluated(t)


@query(
    "comparison_table",
    f"""SELECT m.risk, method, {_METRICS.replace('(pr_auc', '(m.pr_auc')}, min_precision, min_recall,
               CASE WHEN method = 'rules' THEN m.precision >= min_precision AND m.recall >= min_recall END AS goal_met,
               CASE WHEN method = 'rules' THEN CASE WHEN m.pr_auc >= p.pr_auc THEN 'OK' ELSE 'WEAK' END END AS verdict
        FROM o_metrics m
        JOIN (VALUES ('fire', 0.3::DOUBLE, 0.7::DOUBLE), ('flood', 0.3, 0.7), ('failure', 0.4, 0.6),
                     ('intrusion', 0.8, 0.5)) g(risk, min_precision, min_recall) ON g.risk = m.risk
        JOIN (SELECT risk, pr_auc FROM o_metrics WHERE method = 'persist') p ON p.risk = m.risk""",
)
def comparison_table(t: Tables):
    """The rules take the model's place here, so that the result does not depend on a trained model."""
    return curve.comparison_table(evaluated(t), CONFIG, model="rules")


@query(
    "metrics_document",
    f"""SELECT s.split, method, risk, {_METRICS}, positives_pred, positives_true, n
        FROM (SELECT * EXCLUDE (split) FROM o_metrics) m, (SELECT 'test' AS split) s""",
)
def metrics_document(t: Tables):
    """The evaluation stored as the nested metrics document and read back as rows of the test split."""
    metrics = stage(evaluated(t), "metrics")
    both = metrics.withColumn("split", F.explode(F.array(F.lit("valid"), F.lit("test"))))
    counts = metrics.agg(*[F.max("n").alias(f"n_{s}") for s in ("train", "valid", "test")])
    doc = documents.metrics_document(both, metrics.select("method", "risk", "threshold"), counts, FEATURE_COLUMNS)
    path = fresh_path(t.spark, "metrics")
    documents.write_document(doc, path)
    return documents.metrics_rows(documents.read_metrics(t.spark, path))


@query("dataset_job", f"SELECT {columns_sql(PANEL_COLUMNS)}, period AS year FROM o_panel")
def dataset_job(t: Tables):
    """The batch job: events stored by year, features built, written by year and read back."""
    folder = fresh_path(t.spark, "dataset")
    tables.write_table(t.events.withColumn("year", F.year("event_ts")), f"{folder}/events", ["year"])
    jobs.build_dataset(t.spark, f"{folder}/events", t.channels, t.weather, folder, CONFIG)
    return t.spark.read.parquet(f"{folder}/features")


@query(
    "warehouse_job",
    """SELECT 'events_alarm' AS table_name, count(*) AS n_rows FROM o_alarms
       UNION ALL SELECT 'events_hourly', count(*) FROM (
           SELECT DISTINCT e.channel_id, date_trunc('hour', e.event_ts) FROM o_base_doubled e
           JOIN b_channels c ON c.id = e.channel_id WHERE c.sensor_type IN ('temp', 'heat', 'flood', 'pump', 'fan')) h""",
)
def warehouse_job(t: Tables):
    """Both marts loaded from stored events, then counted."""
    folder = fresh_path(t.spark, "warehouse")
    tables.write_table(doubled_events(t).withColumn("year", F.year("event_ts")), f"{folder}/events", ["year"])
    tables.write_table(normalize.clean_channels(t.channels), f"{folder}/channels")
    jobs.load_marts(t.spark, f"{folder}/events", folder, CONFIG)
    return marts.table_counts({
        n: t.spark.read.parquet(f"{folder}/{n}") for n in ("events_alarm", "events_hourly")
    })


@query(
    "warehouse_rebuild",
    """SELECT event_id, channel_id, event_ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS event_ts,
              value_raw, value_num, value_cat FROM o_alarms WHERE event_id % 11 <> 0""",
)
def warehouse_rebuild(t: Tables):
    """Marts loaded, the journal changed (alarms moved by a day, others gone), and loaded again: the alarms in full."""
    folder = fresh_path(t.spark, "rebuild")
    events = t.events.withColumn("year", F.year("event_ts"))
    tables.write_table(events, f"{folder}/events", ["year"])
    tables.write_table(normalize.clean_channels(t.channels), f"{folder}/channels")
    jobs.load_marts(t.spark, f"{folder}/events", folder, CONFIG)
    moved = F.when(F.col("event_id") % 7 == 0, F.col("event_ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("event_ts"))
    changed = t.events.where("event_id % 11 <> 0").withColumn("event_ts", moved)
    tables.write_table(changed.withColumn("year", F.year("event_ts")), f"{folder}/changed", ["year"])
    jobs.load_marts(t.spark, f"{folder}/changed", folder, CONFIG)
    return alarm_store.stored_alarms(t.spark, folder).drop("day", "batch")


# ---- predictions from panel scores ------------------------------------------------------------------------------------


def scored_latest(t: Tables):
    """Newest rows with the persistence score standing in for a model's probability."""
    scored = predictions.risk_rows(predictions.latest_rows(full_panel(t)), persist_score)
    rule, persist = F.lit(None).cast("double"), F.lit(None).cast("double")
    for r in RISKS:
        rule = F.when(F.col("risk_type") == r, rule_score(r)).otherwise(rule)
        persist = F.when(F.col("risk_type") == r, persist_score(r)).otherwise(persist)
    return scored.withColumns({"rule": rule, "persist": persist})


def effective(t: Tables):
    base = feedback.base_thresholds(t.predictions)
    return feedback.effective_thresholds(base, feedback.calibrate(base, t.feedback, t.predictions))


_OPEN_TEXT = """
    title || ' на 24ч.'
    || CASE WHEN s.risk = 'fire' AND fire_24h <> 0 THEN ' пожарных сработок за сутки: ' || fire_24h || '.' ELSE '' END
    || CASE WHEN s.risk = 'flood' AND flood_24h <> 0 THEN ' водяных событий за сутки: ' || flood_24h || '.' ELSE '' END
    || CASE WHEN s.risk = 'flood' AND precip IS NOT NULL
            THEN ' осадки: ' || printf('%.1f', precip) || ' мм.' ELSE '' END
    || CASE WHEN s.risk = 'failure' AND failure_new_24h <> 0
            THEN ' новых отказов за сутки: ' || failure_new_24h || '.' ELSE '' END
    || CASE WHEN s.risk = 'intrusion' THEN CASE WHEN guard_on <> 0 THEN ' на охране.' ELSE ' снято с охраны.' END
            ELSE '' END
    || CASE WHEN s.risk = 'intrusion' AND intrusion_24h <> 0
            THEN ' охранных тревог за сутки: ' || intrusion_24h || '.' ELSE '' END
    || CASE WHEN s.risk = 'failure' AND heating_season = 1 THEN ' отопительный сезон.' ELSE '' END
    || ' ключевые признаки: ev_24h, al_24h, fire_24h.'"""


@query(
    "open_predictions",
    f"""SELECT s.object_id, CAST(NULL AS BIGINT) AS channel_id, s.risk AS risk_type, {rd('s.score', 'probability')},
               24 AS horizon_hours, {_OPEN_TEXT} AS explanation, r.recommendation, 'open' AS status,
               'model' AS source
        FROM (SELECT * FROM o_scores WHERE method = 'persist') s
        JOIN o_latest l ON l.object_id = s.object_id AND l.hour_ts = s.hour_ts
        JOIN o_texts r ON r.risk = s.risk
        JOIN o_calibrated c ON c.risk_type = s.risk WHERE s.score >= c.threshold - 0.5::DOUBLE""",
    extra={
        "o_texts": "SELECT * FROM (VALUES "
        + ", ".join(f"('{r}', '{RISK_TITLES[r]}', '{RECOMMENDATIONS[r]}')" for r in RISKS)
        + ") v(risk, title, recommendation)"
    },
)
def open_predictions(t: Tables):
    """Thresholds lie half lower than calibrated, as the stand-in scores never reach the calibrated ones."""
    top = F.array(F.lit("ev_24h"), F.lit("al_24h"), F.lit("fire_24h"), F.lit("ev_6h"))
    lower = effective(t).withColumn("threshold", F.col("threshold") - 0.5)
    return predictions.open_predictions(scored_latest(t), lower, CONFIG, top)


@query(
    "above_threshold_counts",
    f"""SELECT s.risk AS risk_type, any_value(c.threshold) AS threshold, count_if(s.score >= c.threshold) AS n_above,
               CAST(sum(u.score) AS BIGINT) AS n_rules, {rd('avg(s.score)', 'persist_mean')}
        FROM (SELECT * FROM o_scores WHERE method = 'persist') s
        JOIN (SELECT * FROM o_scores WHERE method = 'rules') u
          ON u.risk = s.risk AND u.object_id = s.object_id AND u.hour_ts = s.hour_ts
        JOIN o_latest l ON l.object_id = s.object_id AND l.hour_ts = s.hour_ts
        JOIN o_calibrated c ON c.risk_type = s.risk GROUP BY s.risk""",
)
def above_threshold_counts(t: Tables):
    return predictions.above_threshold_counts(scored_latest(t), effective(t))


@query(
    "feedback_training_set",
    """SELECT f.id AS feedback_id, p.object_id, p.risk_type, l.hour_ts, l.ev_24h, l.y_fire,
              CASE WHEN f.decision = 'false_alarm' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y,
              CASE WHEN f.decision = 'false_alarm' THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
       FROM b_feedback f JOIN b_predictions p ON p.id = f.prediction_id JOIN o_latest l ON l.object_id = p.object_id
       WHERE f.decision <> 'watch'""",
)
def feedback_training_set(t: Tables):
    return feedback.training_set(t.feedback, t.predictions, full_panel(t)).select(
        "feedback_id", "object_id", "risk_type", "hour_ts", "ev_24h", "y_fire", "y", "weight"
    )


@query(
    "feedback_training_set_point_in_time",
    """SELECT f.id AS feedback_id, p.object_id, l.hour_ts, l.ev_24h
       FROM (SELECT id, prediction_id, decision,
                    TIMESTAMP '2024-01-01 00:30:00' + to_hours(CAST(id % 900 AS INTEGER)) AS at FROM b_feedback) f
       JOIN b_predictions p ON p.id = f.prediction_id
       ASOF JOIN o_panel l ON l.object_id = p.object_id AND f.at >= l.hour_ts
       WHERE f.decision <> 'watch'""",
)
def feedback_point_in_time(t: Tables):
    """Decisions spread over the journal's hours and past its end."""
    start = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    moved = t.feedback.withColumn("created_at", F.timestamp_add("HOUR", (F.col("id") % 900).cast("int"), start))
    return feedback.training_set(moved, t.predictions, full_panel(t), point_in_time=True).select(
        "feedback_id", "object_id", "hour_ts", "ev_24h"
    )


@query(
    "clustered_channel",
    "SELECT event_id, channel_id, event_ts, value_raw FROM b_events WHERE channel_id = (SELECT min(user_id) FROM events)",
)
def clustered_channel(t: Tables):
    """The events of one channel, read from the clustered copy of the stored events."""
    folder = fresh_path(t.spark, "dataset")
    tables.write_table(t.events.withColumn("year", F.year("event_ts")), f"{folder}/events", ["year"])
    jobs.cluster_events(t.spark, f"{folder}/events", f"{folder}/clustered")
    first = t.events.agg(F.min("channel_id").alias("c")).first()["c"]
    rows = t.spark.read.parquet(f"{folder}/clustered").where(F.col("channel_id") == first)
    return rows.select("event_id", "channel_id", "event_ts", "value_raw")
