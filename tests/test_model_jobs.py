"""Stored models score as the fitted ones; predictions follow thresholds; refits take the feedback."""

from pyspark.sql import functions as F

from tests.conftest import SMALL
from undercroft import schemas
from undercroft.config import RISKS
from undercroft.plans import model, model_jobs

SETTINGS = model.ModelConfig(rounds=3, step=0.5, depth=2, min_leaf=2, feature_share="all")


def panel_of(spark):
    return spark.range(600).select(
        (F.col("id") % 20).alias("object_id"), F.lit(2024).alias("year"),
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("hour_ts"),
        *[F.lit(0.0).alias(f"{r}_24h") for r in RISKS], (F.col("id") % 7).cast("double").alias("ev_24h"),
        *[F.lit(0).alias(c) for c in ("fire_6h", "flood_6h", "failure_6h", "intrusion_6h", "fire_1h", "pump_on_6h", "temp_max_6h",
                                      "gas_max_6h", "guard_on", "failure_new_24h", "intrusion_1h", "fire_pickets_6h", "month")],
        *[(F.col("id") % 7 > 3 + i % 2).cast("int").alias(f"y_{r}") for i, r in enumerate(RISKS)],
        F.when(F.col("id") % 3 == 0, "valid").when(F.col("id") % 3 == 1, "test").otherwise("train").alias("split"),
    )


def test_stored_models_score_as_fitted_ones(spark, tmp_path):
    panel = panel_of(spark)
    names = ["ev_24h", "fire_24h"]
    models = model.fit_models(panel, names, SETTINGS)
    model_jobs.save_models(models, str(tmp_path / "m"))
    loaded = model_jobs.load_models(str(tmp_path / "m"))
    columns = ["object_id", "hour_ts", *[f"p_{r}" for r in RISKS]]
    one, two = (sorted(map(tuple, model.model_scores(panel, m, names).select(*columns).collect())) for m in (models, loaded))
    assert one == two


def test_refusal_without_models(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="no trained models"):
        model_jobs.predict_job(spark, panel_of(spark), str(tmp_path / "none"), str(tmp_path), SMALL, F.lit(None).cast("timestamp_ntz"))
    assert schemas.PREDICTIONS.names[0] == "id"
