import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from undercroft import schemas
from undercroft.operators import curve
from undercroft.operators.predictions import with_object_names
from undercroft.plans import jobs
from undercroft.sources import documents, files, tables
from undercroft.sources.weather import weather_rows

OBJECTS = "ид_объект,иерархия_уровень,родитель,вид_объекта,диспетчерское_название_объекта\n"
CHANNELS = "ид_канала_данных,тип_инж_системы,тип_датчика,тег_инженерной_системы,название_датчика,ид_объект\n"
JOURNAL = "ид_события,ид_канала_данных,дата,время,тревожное,значение_датчика\n"


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "objects.csv").write_text(
        "﻿" + OBJECTS + '1,1,,district,"Район, первый"\n2,2,1,controlHouse,Дом\n3,3,77,guardObject,Объект\n', encoding="utf-8")
    (folder / "channels.csv").write_text(
        CHANNELS + "10,s,Датчик дыма,,ПК 1+2,3\n11,s,Датчик температуры,tag,пк 5,3\n12,s,Датчик дыма,,x,999\n", encoding="utf-8")
    return folder


def journal_text(year, rows):
    return JOURNAL + "".join(f"{i},{c},{year}-01-{d:02d},{t},{a},{v}\n" for i, c, d, t, a, v in rows)


def test_kind_detection():
    assert files.detect_kind(['﻿"ид_объект"', " иерархия_уровень ", "родитель", "вид_объекта", "диспетчерское_название_объекта"]) == "objects"
    assert files.detect_kind(CHANNELS.strip().split(",")) == "channels"
    assert files.detect_kind(JOURNAL.strip().split(",")) == "journal"
    with pytest.raises(ValueError):
        files.detect_kind(["a", "b"])


def test_bom_quotes_and_routing(spark, landing):
    routed = files.route_files(spark, files.list_files(spark, str(landing)))
    assert set(routed) == {"objects", "channels"}
    _, rows = files.read_kind(spark, routed["objects"])
    assert {r["id"]: r["name"] for r in rows.collect()}["1"] == "Район, первый"


def test_bad_rows_are_set_aside(spark, tmp_path):
    path = tmp_path / "ext-journal-2024.csv"
    path.write_text(JOURNAL + "1,10,2024-01-01,00:00:00,t,5\n2,10,2024-01-01,00:00:00,t,5,extra,more\n3,10\n", encoding="utf-8")
    rows = files.read_text_rows(spark, [str(path)], files.read_header(spark, str(path)))
    assert [r["ид_события"] for r in files.good_rows(rows).collect()] == ["1"]
    assert sorted(r["line"] for r in files.quarantine(rows).collect()) == [
        "2,10,2024-01-01,00:00:00,t,5,extra,more", "3,10"]


def test_column_order_may_differ_between_files(spark, tmp_path):
    (tmp_path / "a-2023.csv").write_text(JOURNAL + "1,10,2023-01-01,00:00:00,t,5\n", encoding="utf-8")
    (tmp_path / "b-2024.csv").write_text(
        "дата,время,ид_канала_данных,ид_события,значение_датчика,тревожное\n2024-01-01,00:00:00,11,2,ok,f\n", encoding="utf-8")
    (tmp_path / "empty-2025.csv").write_text("")
    found = files.list_files(spark, str(tmp_path))
    assert [f.year for f in found] == [2023, 2024]
    _, rows = files.read_kind(spark, [f.path for f in found])
    got = {r["event_id"]: (r["channel_id"], r["value"], r["year"]) for r in rows.collect()}
    assert got == {"1": ("10", "5", 2023), "2": ("11", "ok", 2024)}


def test_batch_jobs_end_to_end(spark, landing, tmp_path):
    smoke = "Обнаружен дым"
    (landing / "ext-journal-2023.csv").write_text(journal_text(2023, [
        (1, 10, 1, "00:10:00", "t", smoke), (2, 11, 1, "05:00:00", "f", '"21,5"'), (3, 10, 3, "00:00:00", "f", "ok"),
        ("bad", 10, 3, "00:00:00", "f", "ok")]), encoding="utf-8")
    (landing / "ext-journal-2024.csv").write_text(journal_text(2024, [
        (1, 10, 1, "00:10:00", "t", smoke), (5, 10, 4, "00:00:00", "f", "ok")]), encoding="utf-8")
    (landing / "journal-example.csv").write_text(journal_text(2024, [(99, 10, 1, "00:00:00", "t", smoke)]), encoding="utf-8")
    events, house, out = (str(tmp_path / n) for n in ("events", "house", "out"))

    assert jobs.journals_to_parquet(spark, str(landing), events, years=[2023]) == [2023]
    assert jobs.journals_to_parquet(spark, str(landing), events) == [2024]
    assert jobs.journals_to_parquet(spark, str(landing), events) == []
    assert jobs.journals_to_parquet(spark, str(landing), events, years=[2024], force=True) == [2024]
    assert spark.read.parquet(events).count() == 5

    jobs.load_dimensions(spark, str(landing / "objects.csv"), str(landing / "channels.csv"), house)
    jobs.load_marts(spark, events, house, SMALL)
    alarms = spark.read.parquet(f"{house}/events_alarm").collect()
    assert [(r["event_id"], r["event_ts"]) for r in alarms] == [(1, dt.datetime(2023, 1, 1, 0, 10))]
    hourly = spark.read.parquet(f"{house}/events_hourly").collect()
    assert [(r["channel_id"], r["value_mean"]) for r in hourly] == [(11, 21.5)]
    channels = tables.read_table(spark, f"{house}/channels")
    assert {r["id"]: r["picket"] for r in channels.collect()} == {10: "1+2", 11: None, 12: None}

    assert jobs.build_dataset(spark, events, channels, None, out, SMALL) == [2023, 2024]
    assert jobs.build_dataset(spark, events, channels, None, out, SMALL) == []
    assert jobs.build_dataset(spark, events, channels, None, out, SMALL, years=[2024], force=True) == [2024]
    summary = {r["year"]: r for r in tables.read_table(spark, f"{out}/summary").collect()}
    assert set(summary) == {2023, 2024} and summary[2023]["n_rows"] == 25 and summary[2024]["n_rows"] == 49
    assert spark.read.parquet(f"{out}/features").count() == 74


def test_upload_and_bootstrap(spark, landing, tmp_path):
    smoke = "Обнаружен дым"
    (landing / "journal.csv").write_text(journal_text(2024, [
        (1, 10, 1, "", "yes", f" {smoke} "), (2, 11, 1, "01:00:00", "f", "5"), (1, 10, 2, "00:00:00", "t", smoke)]), encoding="utf-8")
    house = str(tmp_path / "house")
    assert jobs.import_bootstrap(spark, str(landing), house) == {"objects": 3, "channels": 3, "journal": 3}
    objects = {r["id"]: r["parent_id"] for r in tables.read_table(spark, f"{house}/objects").collect()}
    assert objects == {1: None, 2: 1, 3: None}
    channels = {r["id"]: (r["object_id"], r["picket"]) for r in tables.read_table(spark, f"{house}/channels").collect()}
    assert channels == {10: (3, "1+2"), 11: (3, "5"), 12: (None, None)}
    jobs.import_files(spark, [str(landing / "journal.csv")], house)
    alarms = spark.read.parquet(f"{house}/events_alarm").collect()
    assert [(r["event_id"], r["event_ts"], r["value_cat"]) for r in alarms] == [(1, dt.datetime(2024, 1, 1), smoke)]
    (landing / "objects2.csv").write_text(OBJECTS + "2,2,,controlHouse,Новое имя\n", encoding="utf-8")
    jobs.import_files(spark, [str(landing / "objects2.csv")], house, "objects")
    names = {r["id"]: r["name"] for r in tables.read_table(spark, f"{house}/objects").collect()}
    assert names[2] == "Новое имя" and len(names) == 3


def test_weather_payloads(spark):
    daily = {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_mean": [1.5], "precipitation_sum": [None, 2.0]}
    df = spark.createDataFrame([(json.dumps({"daily": daily}),)], "payload string")
    got = weather_rows(df).orderBy("day").collect()
    assert [tuple(r)[1:] for r in got] == [(1.5, None, None), (None, 2.0, None)]
    for text in ('{"reason": "limit"}', "not json", '{"daily": {"time": []}}'):
        with pytest.raises(Exception, match="without days"):
            weather_rows(spark.createDataFrame([(text,)], "payload string")).collect()


def test_metrics_document_round_trip(spark, tmp_path):
    rows = [(s, m, r, 0.5, 0.1, 0.2, 3, 4, 10, 0.3) for s in ("valid", "test") for m in ("rules", "model") for r in ("fire", "flood")]
    metrics = spark.createDataFrame(rows, "split string, method string, risk string, threshold double, precision double, "
                                          "recall double, positives_pred long, positives_true long, n long, pr_auc double")
    limits = spark.createDataFrame([("model", "fire", 0.7), ("rules", "fire", 0.5)], "method string, risk string, threshold double")
    counts = spark.createDataFrame([(5, 6, 7)], "n_train long, n_valid long, n_test long")
    gains = spark.createDataFrame([("fire", "a", 0.1), ("fire", "b", 0.9)], "risk string, feature string, gain double")
    path = str(tmp_path / "metrics")
    documents.write_document(documents.metrics_document(metrics, limits, counts, ["a", "b"], gains), path)
    doc = documents.read_metrics(spark, path)
    back = documents.metrics_rows(doc)
    assert back.count() == 4 and back.filter("method = 'model' and risk = 'fire'").first()["pr_auc"] == 0.3
    assert [tuple(r) for r in documents.metrics_thresholds(doc, "model").collect()] == [("fire", 0.7)]
    head = doc.first()
    assert head["n_test"] == 7 and head["features"] == ["a", "b"] and head["shap"]["fire"][0]["feature"] == "b"


def test_missing_or_broken_metrics_fall_back(spark, tmp_path):
    from undercroft.operators.feedback import base_thresholds

    broken = tmp_path / "broken.json"
    broken.write_text("{not json")
    for path in (str(tmp_path / "none.json"), str(broken)):
        known = documents.metrics_thresholds(documents.read_metrics(spark, path), "model")
        got = {r["risk_type"]: r["threshold"] for r in base_thresholds(known, known).collect()}
        assert got == dict.fromkeys(("fire", "flood", "failure", "intrusion"), 0.5)


def test_export_quotes_names(spark, tmp_path):
    preds = spark.createDataFrame([(1, 5, None, "fire", 0.12345, 24, None, None, "open", "rules", None),
                                   (2, 6, None, "flood", 0.5, 24, None, None, "open", "rules", None)], schemas.PREDICTIONS)
    objects = spark.createDataFrame([(5, 1, None, "k", 'Дом "А"; левый')], schemas.OBJECTS)
    path = str(tmp_path / "export")
    documents.write_export(with_object_names(preds, objects).coalesce(1), path)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert lines[0] == "id;object;risk;probability;status;source;horizon"
    assert sorted(lines[1:]) == ['1;"Дом ""А""; левый";Пожар;0.123;open;rules;24', "2;6;Подтопление;0.500;open;rules;24"]


def test_model_pipeline(spark):
    """Fit, score, evaluate and refit on a panel with a learnable rule; missing features are refused."""
    from undercroft.plans import model

    rows = spark.range(600).select(
        (F.col("id") % 20).alias("object_id"),
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("hour_ts"),
        (F.col("id") % 7).cast("double").alias("ev_24h"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).cast("double").alias("precip"),
        *[(F.col("id") % 7 > 3 + i % 2).cast("int").alias(f"y_{r}") for i, r in enumerate(("fire", "flood", "failure", "intrusion"))],
        F.when(F.col("id") % 3 == 0, "valid").when(F.col("id") % 3 == 1, "test").otherwise("train").alias("split"),
    )
    features = ["ev_24h", "precip"]
    small = model.ModelConfig(rounds=3, step=0.5, depth=2, min_leaf=2, feature_share="all")
    models = model.fit_models(rows, features, small)
    scored = model.model_scores(rows, models, features)
    assert scored.filter("(p_fire > 0.5) != (y_fire = 1)").count() == 0
    top = model.feature_ranking(models, features, rows).filter("risk = 'fire' and rank = 1").first()
    assert top["feature"] == "ev_24h"
    with pytest.raises(ValueError, match="precip"):
        model.model_scores(rows.drop("precip"), models, features)
    extra = rows.filter("split = 'train'").select("*", F.lit("fire").alias("risk_type"), F.lit(0.0).alias("y"), F.lit(300.0).alias("weight"))
    refit = model.fit_models(rows, features, small, extra, risks=["fire"])
    before, after = (model.model_scores(rows, {"fire": m["fire"]}, features).agg(F.avg("p_fire")).first()[0] for m in (models, refit))
    assert after < before
    assert curve.KEYS == ("split", "method", "risk")
