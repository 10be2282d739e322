"""The driver contract, and a quick SQL check of queries from every area (all of them: `python -m workload.verify`)."""

import duckdb
import pytest

import __spark_entry__ as entry
from workload.verify import canonical

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUICK = (
    "normalize_events", "normalize_events_lenient", "channels_lenient", "objects_clean", "event_flags", "hourly_mart",
    "alarm_mart", "value_catalogue", "top_alarm_channels", "orphans", "new_failures", "dense_grid", "panel_full",
    "pr_curve_events", "alarm_rule_predictions", "replace_open", "apply_decisions", "calibrate", "object_list",
    "picket_priority", "events_list", "dashboard", "stream_hourly",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_registry():
    # The training-data queries may be absent; their own tests look at them.
    optional = {q for q in entry.queries() if q == "pipeline" or q.startswith("op")  and q[2].isdigit()}
    queries, oracles = (({k: v for k, v in d.items() if k not in optional}) for d in (entry.queries(), entry.oracle_sql()))
    assert set(oracles) <= set(queries) and len(oracles) > 100
    assert set(queries) - set(oracles) == {"model_scores", "model_metrics", "feature_ranking", "retrained_scores"}
    assert set(QUICK) <= set(oracles)


def test_flagship(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 67 and df.count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, got.collect()) == canonical(want.columns, want.fetchall())
