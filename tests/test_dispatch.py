import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, at, channels_frame
from undercroft import schemas
from undercroft.operators import alarm_risk, feedback, hierarchy, predictions
from undercroft.operators.normalize import clean_channels, clean_objects
from undercroft.plans import views


def prediction(spark, rows):
    """rows: (id, object, risk, probability, status, source)"""
    full = [(i, o, None, r, p, 24, "why", "do", s, src, at(0)) for i, o, r, p, s, src in rows]
    return spark.createDataFrame(full, schemas.PREDICTIONS)


def feedback_frame(spark, rows):
    return spark.createDataFrame([(i, p, d, None, "u", at(i)) for i, (p, d) in enumerate(rows)], schemas.FEEDBACK)


def test_calibration_limits_and_full_list(spark):
    preds = prediction(spark, [(1, 1, "fire", 0.5, "open", "rules"), (2, 1, "flood", 0.5, "open", "rules"),
                               (3, 1, "failure", 0.5, "open", "rules")])
    given = [(1, "false_alarm")] * 20 + [(2, "dispatch")] * 20 + [(3, "maintenance"), (3, "watch"), (3, "false_alarm")]
    base = feedback.base_thresholds(preds, spark.createDataFrame([("fire", 0.9)], "risk_type string, threshold double"))
    got = {r["risk_type"]: r for r in feedback.calibrate(base, feedback_frame(spark, given), preds).collect()}
    assert (got["fire"]["shift"], got["fire"]["threshold"]) == (0.15, 0.95)
    assert (got["flood"]["shift"], got["flood"]["threshold"]) == (-0.15, 0.35)
    assert (got["failure"]["n_dispatch"], got["failure"]["n_false_alarm"], got["failure"]["threshold"]) == (1, 1, 0.513)
    assert (got["intrusion"]["threshold"], got["intrusion"]["n_dispatch"]) == (0.5, 0)


def test_decisions(spark):
    preds = prediction(spark, [(1, 1, "fire", 0.5, "open", "rules"), (2, 1, "flood", 0.5, "open", "rules")])
    rows = [(1, "watch", None, False, "u", at(1)), (1, "dispatch", "r", True, "u", at(2)), (2, "nonsense", None, False, "u", at(1)),
            (9, "dispatch", None, False, "u", at(1))]
    accepted, rejected = feedback.split_decisions(spark.createDataFrame(rows, schemas.DECISIONS), preds)
    assert {r["id"]: r["status"] for r in feedback.apply_decisions(preds, accepted).collect()} == {1: "dispatch", 2: "open"}
    assert {(r["prediction_id"], r["problem"]) for r in rejected.collect()} == {
        (2, "illegal decision"), (9, "unknown prediction")}
    assert feedback.feedback_rows(accepted).count() == 2
    draft = feedback.ticket_drafts(accepted.filter("create_ticket"), preds).collect()
    assert [(r["title"], r["body"], r["status"]) for r in draft] == [("Пожар: объект 1", "r", "draft")]


def test_ticket_requests(spark):
    preds = prediction(spark, [(1, 7, "flood", 0.5, "open", "rules")])
    asked = spark.createDataFrame([(1, None, None, None), (1, 8, "own", "text"), (None, None, None, "no title")],
                                  "prediction_id long, object_id long, title string, body string")
    got = {(r["object_id"], r["title"], r["body"]) for r in feedback.ticket_drafts(asked, preds).collect()}
    assert got == {(7, "Подтопление: объект 7", "do"), (8, "own", "text")}


def test_replace_open_scopes(spark):
    old = prediction(spark, [(1, 1, "fire", 0.5, "open", "rules"), (2, 1, "fire", 0.5, "open", "model"),
                             (3, 2, "fire", 0.5, "open", "rules"), (4, 1, "fire", 0.5, "dispatch", "rules")])
    new = prediction(spark, [(9, 1, "flood", 0.9, "open", "rules")])
    one = spark.createDataFrame([(1,)], "object_id long")

    def ids(*args):
        return sorted(r["id"] for r in predictions.replace_open(old, new, *args).collect())

    assert ids("rules") == [2, 4, 9]
    assert ids("rules", one) == [2, 3, 4, 9]
    assert ids("all") == [4, 9]
    with pytest.raises(ValueError):
        predictions.replace_open(old, new, "some")


def test_alarm_rules(spark):
    channels = channels_frame(spark, [(1, "Датчик дыма", "ПК 1", 5), (2, "Датчик дыма", "ПК 2", 5),
                                      (3, "Датчик движения", "x", 5), (4, "Датчик дыма", "x", None)])
    channels = channels.withColumn("picket", F.regexp_extract("name", r"ПК (\d+)", 1))
    newest = at(30)
    rows = [(i, c, t, w, None, w) for i, (c, t, w) in enumerate([
        (1, newest, "Обнаружен дым"), (2, at(6), "Обнаружен дым"), (1, at(5.9), "Обнаружен дым"), (3, at(20), "Движение"),
        (4, at(20), "Обнаружен дым"), (1, at(21), "иное")])]
    alarms = spark.createDataFrame(rows, schemas.ALARMS)
    got = {r["risk_type"]: r for r in alarm_risk.score_alarms(alarms, channels, SMALL).collect()}
    # 0.52 + 2 * 0.08 + 2 * 0.05 + 2 * 0.06, January adds 0.02; the alarm exactly 24 hours old still counts
    assert set(got) == {"fire", "intrusion"}
    assert got["fire"]["probability"] == 0.92 and got["fire"]["channel_id"] == 1
    assert got["intrusion"]["probability"] == 0.65
    assert "событий: 2, каналов: 2. пикетов: 2. отопительный сезон." in got["fire"]["explanation"]
    assert got["fire"]["explanation"].endswith("примеры: Датчик дыма=Обнаружен дым @ 2024-01-01T06:00; "
                                               "Датчик дыма=Обнаружен дым @ 2024-01-02T06:00.")
    assert "одиночная сработка" in got["intrusion"]["explanation"]
    none = alarm_risk.score_alarms(spark.createDataFrame([], schemas.ALARMS), channels, SMALL)
    assert none.count() == 0


def test_tree(spark):
    rows = [(1, 1, None, "k", "root"), (2, 2, 1, "k", "a"), (3, 3, 2, "k", "b"), (4, 4, 3, "k", "c"),
            (5, 1, 99, "k", "lost"), (6, 1, 7, "k", "x"), (7, 1, 6, "k", "y")]
    objects = spark.createDataFrame(rows, schemas.OBJECTS)
    chain = hierarchy.root_first(hierarchy.ancestors(objects)).orderBy("object_id", "position").collect()
    path = {}
    for r in chain:
        path.setdefault(r["object_id"], []).append(r["ancestor_id"])
    # a cycle ends at the first parent met twice; the start itself may be met once
    assert path == {2: [1], 3: [1, 2], 4: [1, 2, 3], 6: [6, 7], 7: [7, 6]}
    assert {r["id"]: r["parent_id"] for r in clean_objects(objects).collect()}[5] is None
    only = hierarchy.ancestors(objects, spark.createDataFrame([(4,)], "object_id long"))
    assert {r["object_id"] for r in only.collect()} == {4}


def test_unknown_object_becomes_null_but_channel_stays(spark):
    channels = channels_frame(spark, [(1, None, "пк 3", 5), (2, "t", None, 6)])
    objects = spark.createDataFrame([(5, 1, None, "k", "n")], schemas.OBJECTS)
    got = clean_channels(channels, objects, "lenient").orderBy("id").collect()
    assert [(r["object_id"], r["sensor_type"], r["name"], r["picket"]) for r in got] == [(5, "", "пк 3", "3"), (None, "t", "", None)]


def test_card_and_pickets(spark):
    channels = channels_frame(spark, [(i, f"type{i}", "ПК 10", 1) for i in range(12)] + [(50, "Датчик дыма", "ПК 2", 1), (51, "z", "x", 1)])
    channels = clean_channels(channels)
    objects = spark.createDataFrame([(1, 1, None, "k", "one")], schemas.OBJECTS)
    preds = prediction(spark, [(1, 1, "fire", 0.4, "open", "rules"), (2, 1, "fire", 0.9, "open", "rules"), (3, 1, "fire", 0.99, "watch", "rules")])
    card = views.object_card(objects, channels, preds, 1, SMALL)
    head = card["object"]().first()
    assert (head["n_channels"], head["n_pickets"]) == (14, 3)
    pickets = card["pickets"]().collect()
    assert [r["picket"] for r in pickets] == ["2", "10", "без пикета"]
    assert len(pickets[1]["sensor_types"]) == 8 and pickets[0]["has_fire"]
    assert [r["id"] for r in card["predictions"]().collect()] == [2, 1]
    assert card["ancestors"]().count() == 0 and card["children"]().count() == 0


def test_priority_keeps_every_hot_picket(spark):
    pickets = spark.createDataFrame([(1, str(i), i, 1) for i in range(50)], "object_id long, picket string, picket_no long, n_channels long")
    hot = spark.createDataFrame([(1, str(i), "fire") for i in range(5, 45)], "object_id long, picket string, risk string")
    assert hierarchy.picket_priority(pickets, hot, SMALL).filter("is_hot").count() == 40
    few = hot.filter("picket in ('40', '41')")
    shown = sorted(int(r["picket"]) for r in hierarchy.picket_priority(pickets, few, SMALL).collect())
    assert shown == [*range(34), 40, 41]


def test_point_in_time_features(spark):
    panel = spark.createDataFrame([(1, at(h), 2024, h) for h in range(5)] + [(1, at(h), 2025, h) for h in range(10, 13)],
                                  "object_id long, hour_ts timestamp_ntz, period int, ev_24h int")
    preds = prediction(spark, [(1, 1, "fire", 0.5, "open", "rules")])
    times = {0: 2.5, 1: 7.0, 2: 11.2, 3: 99.0, 4: -1.0}
    rows = [(i, 1, "dispatch", None, "u", at(h)) for i, h in times.items()]
    given = spark.createDataFrame(rows, schemas.FEEDBACK)
    got = {r["feedback_id"]: r["ev_24h"] for r in feedback.training_set(given, preds, panel, point_in_time=True).collect()}
    assert got == {0: 2, 1: 4, 2: 11, 3: 12}
    newest = feedback.training_set(given, preds, panel).collect()
    assert {r["ev_24h"] for r in newest} == {12} and {r["weight"] for r in newest} == {2.0}


def test_equal_decisions_share_rows(spark):
    """Rows for a fit do not grow with the decisions on one object; decisions and weight are all there."""
    panel = spark.createDataFrame([(1, at(h), 2024, h) for h in range(5)], "object_id long, hour_ts timestamp_ntz, period int, ev_24h int")
    preds = prediction(spark, [(1, 1, "fire", 0.5, "open", "rules")])
    given = spark.createDataFrame([(i, 1, "false_alarm" if i < 23 else "dispatch", None, "u", at(i % 5)) for i in range(27)], schemas.FEEDBACK)
    for known in (False, True):
        plain = feedback.training_set(given, preds, panel, point_in_time=known)
        made = feedback.weighted_training_set(given, preds, panel, point_in_time=known, copies=3).collect()
        assert all(made[0][c] is not None for c in ("risk_type", "ev_24h", "hour_ts"))
        for label, n, weight in ((0.0, 23, 69.0), (1.0, 4, 8.0)):
            mine = [r for r in made if r["y"] == label]
            assert (sum(r["decisions"] for r in mine), sum(r["weight"] for r in mine)) == (n, weight)
            assert len(mine) <= 3 * len({r["hour_ts"] for r in mine})
        whole = feedback.weighted_training_set(given, preds, panel, point_in_time=known)
        columns = ("object_id", "risk_type", "y", "weight", "hour_ts")
        assert sorted(whole.select(*columns).collect()) == sorted(plain.select(*columns).collect())


def test_dashboard_of_nothing(spark):
    empty = spark.createDataFrame([], schemas.PREDICTIONS)
    row = views.dashboard_totals(empty, spark.createDataFrame([], schemas.ALARMS), SMALL).first()
    assert row["open_total"] == 0 and row["open_fire"] == 0 and row["data_to"] is None and row["flood_season"] is False


def test_event_filters(spark):
    alarms = spark.createDataFrame([(i, 1, at(i), "v", None, "v") for i in range(5)], schemas.ALARMS)
    channels = channels_frame(spark, [(1, "t", "x", 1)])
    objects = spark.createDataFrame([], schemas.OBJECTS)
    got = views.event_list(alarms, channels, objects, SMALL, channel_id=1, date_from=at(1), date_to=at(3), limit=2)
    assert sorted(r["event_id"] for r in got.collect()) == [2, 3]
    assert isinstance(at(1), dt.datetime)
