import random

import pytest
from pyspark.sql import functions as F

from undercroft.config import RiskConfig, Target
from undercroft.operators import curve

SCHEMA = "split string, method string, risk string, y int, score double"


def brute(points):
    """Curve points (threshold, precision, recall) by definition, highest threshold first."""
    positives = sum(y for y, _ in points)
    out = []
    for thr in sorted({s for _, s in points}, reverse=True):
        hit = [y for y, s in points if s >= thr]
        out.append((thr, sum(hit) / len(hit), sum(hit) / positives if positives else 1.0))
    return out


def area(points):
    positives = sum(y for y, _ in points)
    if positives in (0, len(points)):
        return 0.0
    total, before = 0.0, 0.0
    for _, precision, recall in brute(points):
        total += (recall - before) * precision
        before = recall
    return total


def frame(spark, groups):
    rows = [("s", "m", risk, y, float(x)) for risk, points in groups.items() for y, x in points]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def groups():
    rnd = random.Random(3)
    ties = [(int(rnd.random() < 0.3), round(rnd.random(), 1)) for _ in range(400)]
    return {
        "fire": ties, "flood": [(0, 0.1 * i) for i in range(5)], "failure": [(1, 0.1 * i) for i in range(5)],
        "intrusion": [(int(rnd.random() < 0.5), rnd.random()) for _ in range(300)],
    }


def test_curve_area_and_thresholds(spark, groups):
    points = curve.pr_curve(frame(spark, groups)).cache()
    areas = {r["risk"]: r["pr_auc"] for r in curve.average_precision(points).collect()}
    chosen = {r["risk"]: r["threshold"] for r in curve.choose_thresholds(points, RiskConfig()).collect()}
    for risk, data in groups.items():
        got = points.filter(F.col("risk") == risk).orderBy(F.desc("threshold")).collect()
        want = brute(data)
        assert [r["threshold"] for r in got] == [w[0] for w in want]
        assert [r["precision"] for r in got] == pytest.approx([w[1] for w in want])
        assert [r["recall"] for r in got] == pytest.approx([w[2] for w in want])
        assert areas[risk] == pytest.approx(area(data))
        goal = RiskConfig().targets[risk]
        if goal.strategy == "recall_first":
            good = [(p, -t) for t, p, r in want if r >= goal.min_recall] or [(r, -t) for t, p, r in want]
        else:
            good = [(r, -t) for t, p, r in want if p >= goal.min_precision] or [(p, -t) for t, p, r in want]
        assert chosen[risk] == -max(good)[1]


def test_fallbacks_when_goals_are_out_of_reach(spark, groups):
    points = curve.pr_curve(frame(spark, groups)).cache()
    strict = RiskConfig(targets={"fire": Target(2.0, 0.5, "precision_first"), "intrusion": Target(0.5, 2.0, "recall_first")})
    chosen = {r["risk"]: r["threshold"] for r in curve.choose_thresholds(points, strict).collect()}
    fire, intrusion = brute(groups["fire"]), brute(groups["intrusion"])
    assert chosen["fire"] == -max((p, -t) for t, p, _ in fire)[1]
    assert chosen["intrusion"] == -max((r, -t) for t, _, r in intrusion)[1]


def test_metrics_at_threshold(spark):
    scores = frame(spark, {"fire": [(1, 0.9), (0, 0.8), (1, 0.2), (0, 0.1)], "flood": [(0, 0.3)]})
    limits = spark.createDataFrame([("m", "fire", 0.5), ("m", "flood", 0.9)], "method string, risk string, threshold double")
    got = {r["risk"]: r for r in curve.metrics_at_threshold(scores, limits).collect()}
    assert (got["fire"]["precision"], got["fire"]["recall"], got["fire"]["positives_pred"]) == (0.5, 0.5, 2)
    assert (got["flood"]["precision"], got["flood"]["recall"], got["flood"]["n"]) == (0.0, 0.0, 1)


def test_comparison_marks(spark):
    rows = [("persist", 0.5, 0.5, 0.4), ("model", 0.35, 0.8, 0.5), ("rules", 0.9, 0.9, 0.1)]
    metrics = spark.createDataFrame([("test", m, "fire", 0.5, p, r, a) for m, p, r, a in rows],
                                    "split string, method string, risk string, threshold double, precision double, "
                                    "recall double, pr_auc double")
    got = {r["method"]: (r["goal_met"], r["verdict"]) for r in curve.comparison_table(metrics, RiskConfig()).collect()}
    assert got == {"persist": (None, None), "rules": (None, None), "model": (True, "OK")}
