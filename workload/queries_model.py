"""Model queries. Trees are random by nature, so these are checked by rows and in tests, not by SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from undercroft.config import RISKS
from undercroft.operators import curve, feedback
from undercroft.plans import boosting, model, model_jobs
from undercroft.session import fresh_path, stage
from undercroft.sources.tables import read_table
from workload.binding import CONFIG, Tables
from workload.queries_panel import full_panel
from workload.registry import query

# Few rounds: the point is the pipeline, not the model.
SMALL = model.ModelConfig(rounds=4, step=0.3, depth=4, min_leaf=20)


def split_panel(t: Tables):
    """The bound data is one month, so the splits are by day instead of by year."""
    day = F.dayofmonth("hour_ts")
    split = F.when(day <= 15, "train").when(day <= 22, "valid").otherwise("test")
    return stage(full_panel(t).withColumn("split", split), "panel")


@query("model_scores")
def model_scores(t: Tables):
    panel = split_panel(t)
    names = model.panel_features(panel)
    scored = model.model_scores(panel, model.fit_models(panel, names, SMALL), names)
    return scored.select("object_id", "hour_ts", "split", *[f"p_{r}" for r in RISKS])


@query("model_metrics")
def model_metrics(t: Tables):
    """Model, rules and persistence on the valid and test splits, with goals and verdicts for the test split."""
    panel = split_panel(t)
    names = model.panel_features(panel)
    scored = model.model_scores(panel, model.fit_models(panel, names, SMALL), names)
    long = model.long_model_scores(scored.filter(F.col("split") != "train"))
    metrics, _ = model.evaluate_splits(long, CONFIG)
    return curve.comparison_table(metrics.filter(F.col("split") == "test"), CONFIG)


@query("feature_ranking")
def feature_ranking(t: Tables):
    panel = split_panel(t)
    names = model.panel_features(panel)
    return model.feature_ranking(model.fit_models(panel, names, SMALL), names, panel)


@query("retrained_scores")
def retrained_scores(t: Tables):
    """The model refitted with the dispatcher's decisions as weighted extra rows."""
    panel = split_panel(t)
    names = model.panel_features(panel)
    extra = feedback.weighted_training_set(t.feedback, t.predictions, panel.drop("split"))
    models = model.fit_models(panel, names, SMALL, extra)
    return model.model_scores(panel.filter(F.col("split") == "test"), models, names).select(
        "object_id", "hour_ts", *[f"p_{r}" for r in RISKS]
    )


@query(
    "split_rows",
    """SELECT split, count(*) AS n_rows, CAST(sum(y_fire) AS BIGINT) AS fire, CAST(sum(y_flood) AS BIGINT) AS flood,
              CAST(sum(y_failure) AS BIGINT) AS failure, CAST(sum(y_intrusion) AS BIGINT) AS intrusion
       FROM (SELECT *, CASE WHEN day(hour_ts) <= 15 THEN 'train' WHEN day(hour_ts) <= 22 THEN 'valid' ELSE 'test' END AS split
             FROM o_panel) p GROUP BY split""",
)
def split_rows(t: Tables):
    """Rows and positives of each split, which the classes' weights come from."""
    return split_panel(t).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"y_{r}").cast("bigint").alias(r) for r in RISKS])


@query("predict_job", "SELECT id, status, source FROM b_predictions WHERE status <> 'open'")
def predict_job(t: Tables):
    """Train, store, load, predict: what is left of the old predictions is fixed, the new ones are the models'."""
    house = fresh_path(t.spark, "house")
    panel = split_panel(t)
    model_jobs.train_job(panel, f"{house}/models", CONFIG, SMALL)
    t.predictions.write.parquet(f"{house}/predictions")
    model_jobs.predict_job(t.spark, panel, f"{house}/models", house, CONFIG, F.lit("2024-02-01").cast("timestamp_ntz"))
    stored = read_table(t.spark, f"{house}/predictions")
    return stored.filter("status <> 'open'").select("id", "status", "source")


def stored_models(t: Tables) -> tuple:
    """(panel, house): the trained models and the given predictions and feedback in a folder of their own."""
    house = fresh_path(t.spark, "house")
    panel = split_panel(t)
    model_jobs.train_job(panel, f"{house}/models", CONFIG, SMALL)
    t.predictions.write.parquet(f"{house}/predictions")
    t.feedback.write.parquet(f"{house}/feedback")
    return panel, house


@query(
    "predict_job_open",
    f"""SELECT object_id, risk_type, true AS as_scored FROM (SELECT DISTINCT object_id FROM o_panel) o,
               (SELECT unnest(['{"', '".join(RISKS)}']) AS risk_type) r""",
)
def predict_job_open(t: Tables):
    """Open predictions of the job under thresholds of 0: one for each object and risk, with the probability that the
    stored model gives the object's newest row."""
    panel, house = stored_models(t)
    rows = [(r, 0.0) for r in RISKS]
    t.spark.createDataFrame(rows, "risk_type string, threshold double").write.parquet(f"{house}/calibration")
    model_jobs.predict_job(t.spark, panel, f"{house}/models", house, CONFIG, F.lit("2024-02-01").cast("timestamp_ntz"))
    made = read_table(t.spark, f"{house}/predictions").filter("status = 'open'").select("object_id", "risk_type", "probability")
    names = model.panel_features(panel)
    newest = panel.groupBy("object_id").agg(F.max("hour_ts").alias("hour_ts"))
    scored = model.model_scores(panel.join(newest, ["object_id", "hour_ts"]), model_jobs.load_models(f"{house}/models"), names)
    wanted = scored.select("object_id", F.inline(F.array(*[
        F.struct(F.lit(r).alias("risk_type"), F.col(f"p_{r}").alias("_score")) for r in RISKS])))
    return made.join(wanted, ["object_id", "risk_type"]).select(
        "object_id", "risk_type", (F.abs(F.col("probability") - F.col("_score")) < 0.001).alias("as_scored"))


@query(
    "retrain_job",
    """SELECT p.risk_type AS risk, count(*) AS n, 10 AS added, true AS first_kept, true AS loss_fell
       FROM b_feedback f JOIN b_predictions p ON p.id = f.prediction_id
       JOIN (SELECT DISTINCT object_id FROM o_panel) o ON o.object_id = p.object_id
       WHERE f.decision IN ('dispatch', 'maintenance', 'false_alarm') GROUP BY p.risk_type""",
)
def retrain_job(t: Tables):
    """Decisions used, trees added to each stored model, whether its own trees stayed, and whether the loss on the
    decisions fell."""
    panel, house = stored_models(t)
    folder, settings = f"{house}/models", model_jobs.RetrainConfig(rounds=10, step=0.1, depth=3)
    before = model_jobs.load_models(folder)
    names = model.panel_features(panel)
    rows = feedback.weighted_training_set(t.feedback, t.predictions, panel.drop("split"))
    rows = stage(model.with_vector(rows, names).select("risk_type", "features", F.col("y").cast("double").alias("label"), "weight"), "rows")
    report = model_jobs.retrain_job(t.spark, panel, folder, house, settings, period="period", point_in_time=False)
    after = model_jobs.load_models(folder)

    def look(risk: str) -> tuple:
        old, new = before[risk], after[risk]
        same = [a.toDebugString for a in old.trees] == [b.toDebugString for b in new.trees[:len(old.trees)]]
        mine = rows.filter(F.col("risk_type") == risk)
        losses = [boosting.log_loss(m, mine) for m in (old, new)]
        return risk, report[risk][0], len(new.trees) - len(old.trees), same, losses[1] < losses[0]
    return t.spark.createDataFrame([look(r) for r in report], "risk string, n long, added int, first_kept boolean, loss_fell boolean")


@query(
    "contribution_ranking",
    f"""SELECT risk, 12 AS n_features, true AS falling, true AS adds_up
        FROM (SELECT unnest(['{"', '".join(RISKS)}']) AS risk) r, (SELECT count(*) AS n FROM o_panel) p WHERE n > 0""",
)
def contribution_ranking(t: Tables):
    """Leading features by contribution for each risk: a falling list; and for the rows that it was read from, the
    contributions add up to the distance of the margin from the model's mean."""
    panel = split_panel(t)
    names = model.panel_features(panel)
    models = model.fit_models(panel, names, SMALL)
    valid = panel.filter(F.col("split") == "valid")
    ranked = model.contribution_ranking(models, names, valid)
    before = Window.partitionBy("risk").orderBy("rank")
    falling = ranked.withColumn("_ok", F.coalesce(F.col("mean_abs_shap") <= F.lag("mean_abs_shap").over(before), F.lit(True)))
    lists = falling.groupBy("risk").agg(F.count(F.lit(1)).cast("int").alias("n_features"), F.bool_and("_ok").alias("falling"))
    rows = model.with_vector(valid, names).select("features")
    checks = [(r, boosting.adds_up(rows, boosting.read_ensemble(t.spark, m))) for r, m in models.items()]
    return lists.join(t.spark.createDataFrame(checks, "risk string, adds_up boolean"), "risk")


@query(
    "best_rounds",
    f"""SELECT risk, true AS in_bounds, true AS none_better FROM (SELECT unnest(['{"', '".join(RISKS)}']) AS risk) r,
               (SELECT count(*) AS n FROM o_panel) p WHERE n > 0""",
)
def best_rounds(t: Tables):
    """Rounds kept of a fit with patience: none before the last is better on the valid rows."""
    panel = split_panel(t)
    names = model.panel_features(panel)
    settings = model.ModelConfig(rounds=8, step=0.3, depth=4, min_leaf=20, patience=3)
    models = model.fit_models(panel, names, settings)
    valid = stage(model.with_vector(panel.filter(F.col("split") == "valid"), names).select("features", *[f"y_{r}" for r in RISKS]), "valid")
    found = []
    for risk, fitted in models.items():
        precision = boosting.precision_by_round(
            valid.select("features", F.col(f"y_{risk}").alias("label")), boosting.read_ensemble(t.spark, fitted))
        # One-class labels give no precision to compare; all rounds stay.
        found.append((risk, 1 <= len(precision) <= 8, bool(precision.max() <= precision[-1])))
    return t.spark.createDataFrame(found, "risk string, in_bounds boolean, none_better boolean")
