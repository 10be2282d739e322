"""The given tables seen as a sensor journal.

Each view is one SELECT understood alike by Spark and by the checking engine, so a difference found by a check
lies in an operator and never in its input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from undercroft.config import RiskConfig

# Vocabulary of the bound data. `fault` is a signup worth more than 60.
CONFIG = RiskConfig(
    fire_pairs=(("smoke", "error"), ("gas", "error"), ("heat", "purchase")),
    flood_pairs=(("pump", "error"), ("flood", "purchase")),
    failure_values=("fault",),
    intrusion_types=("motion",),
    intrusion_pairs=(("fan", "fault"),),
    smoke_type="smoke",
    heat_type="heat",
    flood_sensor_type="flood",
    temp_types=("temp",),
    gas_types=("gas",),
    pump_type="pump",
    fan_type="fan",
    guard_type="guard",
    door_types=("motion", "guard"),
    on_value="view",
    guard_on_value="click",
    hourly_types=("temp", "heat", "flood", "pump", "fan"),
    card_fire_types=("smoke", "heat", "gas"),
    card_flood_types=("flood", "pump"),
    card_guard_types=("motion",),
    temp_min=0.5,
    temp_max=200.0,
    noisy_fire_events=15,
    noisy_flood_events=15,
    min_object_events=20,
)

VIEWS = {
    "b_channels": """
        SELECT u AS id,
               concat('sys', u % 3) AS system_type,
               CASE u % 9 WHEN 0 THEN 'smoke' WHEN 1 THEN 'heat' WHEN 2 THEN 'gas' WHEN 3 THEN 'flood'
                          WHEN 4 THEN 'pump' WHEN 5 THEN 'fan' WHEN 6 THEN 'motion' WHEN 7 THEN 'temp'
                          ELSE 'guard' END AS sensor_type,
               CASE WHEN u % 4 = 0 THEN NULL ELSE concat('tag', u % 11) END AS tag,
               CASE WHEN u % 13 = 0 THEN 'sensor' ELSE concat('ПК ', u % 7, '+', u % 10) END AS name,
               CASE WHEN u % 31 = 30 THEN NULL ELSE u % 25 END AS object_id
        FROM (SELECT DISTINCT user_id AS u FROM events) d
    """,
    "b_events": """
        SELECT event_id, user_id AS channel_id, ts AS event_ts,
               (event_type = 'error' OR value > 120) AS is_alarm,
               CAST(value AS STRING) AS value_raw, value AS value_num,
               CASE WHEN event_type = 'signup' AND value > 60 THEN 'fault' ELSE event_type END AS value_cat
        FROM events
    """,
    "b_journal_raw": """
        SELECT CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE CAST(event_id AS STRING) END AS event_id,
               CASE WHEN event_id % 101 = 0 THEN '99999' ELSE CAST(user_id AS STRING) END AS channel_id,
               substr(CAST(ts AS STRING), 1, 10) AS date,
               CASE WHEN event_id % 89 = 0 THEN NULL ELSE substr(CAST(ts AS STRING), 12, 8) END AS time,
               CASE WHEN event_type = 'error' THEN 't' WHEN value > 120 THEN 'TRUE'
                    WHEN event_id % 50 = 0 THEN 'yes' ELSE 'f' END AS alarm,
               CASE event_id % 20 WHEN 0 THEN '01.01.1970 00:00:00' WHEN 1 THEN NULL
                    WHEN 2 THEN replace(CAST(value AS STRING), '.', ',')
                    WHEN 3 THEN event_type WHEN 4 THEN ' ok ' ELSE CAST(value AS STRING) END AS value
        FROM events
    """,
    "b_objects": """
        SELECT 1000000000000 + r_regionkey AS id, 1 AS level, CAST(NULL AS BIGINT) AS parent_id,
               'district' AS kind, r_name AS name FROM region
        UNION ALL
        SELECT 2000000000000 + n_nationkey, 2, 1000000000000 + n_regionkey, 'controlHouse', n_name FROM nation
        UNION ALL
        SELECT s_suppkey, 3,
               CASE WHEN s_suppkey % 17 = 0 THEN 9999000000000 ELSE 2000000000000 + s_nationkey END,
               'guardObject', s_name FROM supplier
    """,
    "b_weather": """
        SELECT day, round(avg(value), 6) AS temp_mean, round(sum(value) / 100, 6) AS precipitation_mm,
               CASE WHEN extract(day FROM day) % 5 = 0 THEN NULL ELSE CAST(50 AS DOUBLE) END AS humidity
        FROM (SELECT CAST(ts AS DATE) AS day, value FROM events) e
        WHERE extract(day FROM day) % 7 <> 0
        GROUP BY day
    """,
    "b_predictions": """
        SELECT o_orderkey AS id, o_custkey % 25 AS object_id, CAST(NULL AS BIGINT) AS channel_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'fire' WHEN 1 THEN 'flood' WHEN 2 THEN 'failure'
                    ELSE 'intrusion' END AS risk_type,
               round(o_totalprice / (o_totalprice + 100000), 3) AS probability, 24 AS horizon_hours,
               concat('because ', o_orderpriority) AS explanation,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'inspect' END AS recommendation,
               CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'dispatch' ELSE 'false_alarm' END AS status,
               CASE WHEN o_orderkey % 2 = 0 THEN 'rules' ELSE 'model' END AS source,
               o_orderdate AS created_at
        FROM orders
    """,
    "b_feedback": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS prediction_id,
               CASE (l_linenumber + l_suppkey) % 4 WHEN 0 THEN 'dispatch' WHEN 1 THEN 'false_alarm'
                    WHEN 2 THEN 'watch' ELSE 'maintenance' END AS decision,
               concat('part ', l_partkey) AS reason, concat('user', l_suppkey % 5) AS user_login,
               l_shipdate AS created_at
        FROM lineitem
    """,
}
BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
)


class Tables:
    """The views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        needed = {t: self.base(t) for t in BASE_TABLES if f"FROM {t}" in text}
        for table in needed:
            text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
        return self.spark.sql(text, **needed)

    channels = cached_property(lambda self: self.view("b_channels"))
    events = cached_property(lambda self: self.view("b_events"))
    journal_raw = cached_property(lambda self: self.view("b_journal_raw"))
    objects = cached_property(lambda self: self.view("b_objects"))
    weather = cached_property(lambda self: self.view("b_weather"))
    predictions = cached_property(lambda self: self.view("b_predictions"))
    feedback = cached_property(lambda self: self.view("b_feedback"))
