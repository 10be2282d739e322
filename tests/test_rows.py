import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from undercroft.operators import rows


def test_first_per_key_and_alarm_dedup(spark):
    from undercroft.operators.marts import alarm_mart

    data = [(1, 10, at(3), True, "c", None, "c"), (1, 10, at(1), True, "a", None, "a"), (1, 10, at(2), True, "b", None, "b"),
            (2, 10, None, True, "x", None, "x"), (3, 10, at(0), False, "y", None, "y"), (4, 10, at(0), None, "z", None, "z")]
    events = spark.createDataFrame(
        data, "event_id long, channel_id long, event_ts timestamp_ntz, is_alarm boolean, value_raw string, "
              "value_num double, value_cat string")
    got = alarm_mart(events).collect()
    assert [(r["event_id"], r["value_raw"]) for r in got] == [(1, "a")]


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "old", 9), (2, "keep", 1)], "id int, v string, t int")
    batch = spark.createDataFrame([(1, "new", 1), (3, "x", 1), (3, "y", 2)], "id int, v string, t int")
    merged = rows.upsert_latest(stored, batch, ["id"], [F.desc("t")]).orderBy("id").collect()
    assert [tuple(r) for r in merged] == [(1, "new", 1), (2, "keep", 1), (3, "y", 2)]
    fresh = rows.insert_new(stored, batch, "id", [F.asc("t")]).collect()
    assert [tuple(r) for r in fresh] == [(3, "x", 1)]


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_running_totals_equal_pandas(spark, hot):
    """With and without a key that owns most rows."""
    pdf = pd.DataFrame({"k": [0 if i % 10 < hot * 10 else i % 7 for i in range(3000)],
                        "o": [(i * 7919) % 3001 for i in range(3000)], "v": [i % 5 for i in range(3000)]})
    df = spark.createDataFrame(pdf)
    got = rows.running_totals(df, ["k"], [F.desc("o")], {"total": F.col("v"), "n": F.lit(1).cast("bigint")}).toPandas()
    want = pdf.sort_values(["k", "o"], ascending=[True, False])
    want["total"], want["n"] = want.groupby("k")["v"].cumsum(), want.groupby("k").cumcount() + 1
    both = got.merge(want, on=["k", "o"], suffixes=("", "_w"))
    assert len(both) == 3000 and (both["total"] == both["total_w"]).all() and (both["n"] == both["n_w"]).all()


def test_assigned_ids(spark):
    existing = spark.createDataFrame([(5,), (11,)], "event_id long")
    batch = spark.createDataFrame([(None, 1), (7, 2), (None, 3)], "event_id long, o int")
    got = rows.assign_running_ids(batch, existing, "event_id", [F.asc("o")]).orderBy("o").collect()
    assert [r["event_id"] for r in got] == [12, 7, 14]
    empty = spark.createDataFrame([], "event_id long")
    assert rows.assign_running_ids(batch, empty, "event_id", [F.asc("o")]).agg(F.min("event_id")).first()[0] == 1


def test_hashed_ids_are_stable_and_positive(spark):
    df = spark.range(500).select(rows.hashed_id(F.col("id"), F.lit("x")).alias("h"))
    assert df.filter("h < 0").count() == 0 and df.distinct().count() == 500


def test_sample_is_reproducible(spark):
    df = spark.range(1000).repartition(7)
    a = sorted(r[0] for r in rows.reproducible_sample(df, ["id"], 50).collect())
    b = sorted(r[0] for r in rows.reproducible_sample(df.repartition(3), ["id"], 50).collect())
    assert a == b and len(set(a)) == 50
    assert a != sorted(r[0] for r in rows.reproducible_sample(df, ["id"], 50, seed=1).collect())
