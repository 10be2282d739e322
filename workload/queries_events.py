"""Normalisation, event predicates, marts and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from undercroft.functions.rules import classify_event, event_flags
from undercroft.functions.values import value_kind
from undercroft.operators import marts, normalize, profiling, rows
from undercroft.sources.weather import weather_rows
from workload.binding import CONFIG, Tables
from workload.oracles import CLASSIFY, FAILURE, FIRE, FLOOD, INTRUSION, rd
from workload.registry import query

mart_channels = normalize.clean_channels


def typed_events(t: Tables):
    """Events with their channel's sensor type: the row-level join."""
    dims = t.channels.select(F.col("id").alias("channel_id"), "sensor_type", "object_id")
    return t.events.join(dims, "channel_id")


@query("normalize_events", "SELECT * FROM o_norm")
def normalize_events(t: Tables):
    return normalize.normalize_events(t.journal_raw)


@query("normalize_events_lenient", "SELECT * FROM o_lenient")
def normalize_events_lenient(t: Tables):
    return normalize.normalize_events(t.journal_raw, "lenient")


@query(
    "uploaded_alarms",
    "SELECT event_id, channel_id, event_ts, value_raw, value_num, value_cat FROM o_lenient "
    "WHERE is_alarm AND event_ts IS NOT NULL",
)
def uploaded_alarms(t: Tables):
    return normalize.uploaded_alarms(t.journal_raw)


@query(
    "objects_clean",
    """SELECT o.id, o.level, p.id AS parent_id, o.kind, o.name
       FROM b_objects o LEFT JOIN b_objects p ON p.id = o.parent_id""",
)
def objects_clean(t: Tables):
    return normalize.clean_objects(t.objects)


@query("channels_picket", "SELECT * FROM o_mart_channels")
def channels_picket(t: Tables):
    return normalize.clean_channels(t.channels)


@query(
    "channels_lenient",
    r"""SELECT c.id, coalesce(c.system_type, '') AS system_type, coalesce(c.sensor_type, '') AS sensor_type, c.tag,
               coalesce(c.name, '') AS name, o.id AS object_id,
               nullif(regexp_extract(c.name, '(?i)ПК\s*(\d+(?:[.,+]\d+)*)', 1), '') AS picket
        FROM b_channels c LEFT JOIN b_objects o ON o.id = c.object_id AND o.level = 3""",
)
def channels_lenient(t: Tables):
    return normalize.clean_channels(t.channels, t.objects, "lenient")


@query(
    "event_flags",
    f"""SELECT event_id, coalesce({FIRE}, false) AS ev_fire, coalesce({FLOOD}, false) AS ev_flood,
               coalesce({FAILURE}, false) AS ev_failure, coalesce({INTRUSION}, false) AS ev_intrusion,
               CASE WHEN st = 'temp' AND v BETWEEN 0.5 AND 200 THEN v END AS temp_val,
               CASE WHEN st = 'gas' THEN v END AS gas_val,
               st = 'pump' AND w = 'view' AS pump_on, st = 'fan' AND w = 'view' AS fan_on,
               st = 'guard' AND w = 'click' AS guard_set
        FROM (SELECT e.event_id, e.is_alarm, e.value_cat AS w, e.value_num AS v, c.sensor_type AS st
              FROM b_events e JOIN b_channels c ON c.id = e.channel_id) j""",
)
def flags(t: Tables):
    return typed_events(t).select("event_id", *[c.alias(n) for n, c in event_flags(CONFIG).items()])


@query(
    "classify_event",
    f"""SELECT event_id, {CLASSIFY.replace("WHEN st = 'motion'", "WHEN st = 'motion' OR (st = 'fan' AND w = 'fault')")}
               AS risk
        FROM (SELECT e.event_id, e.value_cat AS w, c.sensor_type AS st
              FROM b_events e JOIN b_channels c ON c.id = e.channel_id) j""",
)
def classify(t: Tables):
    return typed_events(t).select(
        "event_id", classify_event(F.col("sensor_type"), F.col("value_cat"), CONFIG).alias("risk")
    )


_KIND = r"""CASE WHEN value IS NULL OR trim(value) = '' THEN 'empty' WHEN value LIKE '%01.01.1970%' THEN 'epoch_junk'
            WHEN regexp_full_match(replace(trim(value), ' ', ''), '-?\d+(?:[.,]\d+)?') THEN 'numeric'
            ELSE 'categorical' END"""


@query("value_kinds", f"SELECT {_KIND} AS kind, count(*) AS n FROM b_journal_raw GROUP BY ALL")
def value_kinds(t: Tables):
    return t.journal_raw.groupBy(value_kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "value_catalogue",
    f"""SELECT v.*, {_KIND.replace('value', 'value_raw')} AS kind
        FROM (SELECT value AS value_raw, lower(alarm) IN ('t', 'true', '1') AS is_alarm, count(*) AS n
              FROM b_journal_raw GROUP BY ALL ORDER BY n DESC, value_raw NULLS FIRST, is_alarm LIMIT 400) v""",
)
def value_catalogue(t: Tables):
    raw = t.journal_raw.select(
        F.col("value").alias("value_raw"), F.lower("alarm").isin("t", "true", "1").alias("is_alarm")
    )
    return profiling.value_catalogue(raw, 400)


@query(
    "value_kinds_top",
    f"""SELECT {_KIND} AS kind, CAST(sum(n) AS BIGINT) AS n
        FROM (SELECT value, lower(alarm) IN ('t', 'true', '1') AS is_alarm, count(*) AS n
              FROM b_journal_raw GROUP BY ALL ORDER BY n DESC, value NULLS FIRST, is_alarm LIMIT 400) v GROUP BY ALL""",
)
def value_kinds_top(t: Tables):
    return profiling.value_kinds(value_catalogue(t))


@query(
    "hourly_mart",
    f"""SELECT e.channel_id, date_trunc('hour', e.event_ts) AS hour_ts, count(*) AS n_events,
               count_if(is_alarm) AS n_alarms, {rd('avg(value_num)', 'value_mean')}, min(value_num) AS value_min,
               max(value_num) AS value_max
        FROM b_events e JOIN b_channels c ON c.id = e.channel_id
        WHERE c.sensor_type IN ('temp', 'heat', 'flood', 'pump', 'fan')
        GROUP BY e.channel_id, date_trunc('hour', e.event_ts)""",
)
def hourly_mart(t: Tables):
    return marts.hourly_mart(t.events, t.channels, CONFIG)


def doubled_events(t: Tables):
    """Events with every tenth id repeated an hour later, as overlapping journal files do."""
    again = t.events.filter(F.col("event_id") % 10 == 0)
    again = again.withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 1 HOUR"))
    return t.events.unionByName(again)


@query(
    "alarm_mart",
    """SELECT event_id, channel_id, event_ts, value_raw, value_num, value_cat FROM (
           SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_ts) AS rn
           FROM o_base_doubled WHERE is_alarm) d WHERE rn = 1""",
)
def alarm_mart(t: Tables):
    return marts.alarm_mart(doubled_events(t))


@query(
    "upsert_insert_new",
    """SELECT event_id, channel_id, event_ts, value_raw, value_num, value_cat FROM o_alarms
       WHERE event_ts > TIMESTAMP '2024-01-15 00:00:00'""",
)
def insert_new(t: Tables):
    """New alarms of an overlapping batch (the whole doubled journal) against a mart that ends on 15 January."""
    alarms = t.events.filter("is_alarm").select(*marts.ALARM_COLUMNS)
    stored = alarms.filter(F.col("event_ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    batch = doubled_events(t).filter("is_alarm").select(*marts.ALARM_COLUMNS)
    return rows.insert_new(stored, batch, "event_id", [F.asc("event_ts")])


@query(
    "upsert_latest",
    """SELECT e.channel_id, e.event_id, e.value_num, e.event_ts FROM b_events e
       JOIN (SELECT channel_id, max(event_id) AS event_id FROM b_events GROUP BY channel_id) m
         ON m.channel_id = e.channel_id AND m.event_id = e.event_id""",
)
def upsert_latest(t: Tables):
    """Last value per channel: purchases stored first, then every event upserted with the newest id winning."""
    base = t.events.select("channel_id", "event_id", "value_num", "event_ts")
    stored = rows.first_per_key(
        t.events.filter(F.col("value_cat") == "purchase").select(*base.columns), ["channel_id"], [F.desc("event_id")]
    )
    return rows.upsert_latest(stored, base, ["channel_id"], [F.desc("event_id")])


@query(
    "assign_ids",
    """SELECT coalesce(given, top + pos) AS event_id, src FROM (
           SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS given, event_id AS src,
                  row_number() OVER (ORDER BY event_ts, event_id) AS pos,
                  (SELECT max(event_id) FROM b_events) AS top
           FROM b_events WHERE is_alarm) n""",
)
def assign_ids(t: Tables):
    """Alarms of which every third lost its id; lost ids continue after the stored maximum by arrival order."""
    batch = t.events.filter("is_alarm").select(
        F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("event_id"),
        F.col("event_id").alias("src"), "event_ts",
    )
    return rows.assign_running_ids(batch, t.events, "event_id", [F.asc("event_ts"), F.asc("src")]).select(
        "event_id", "src"
    )


@query(
    "reproducible_sample",
    """SELECT event_id, channel_id FROM b_events
       ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id LIMIT 800""",
)
def sample(t: Tables):
    return rows.reproducible_sample(t.events.select("event_id", "channel_id"), ["event_id"], 800)


@query(
    "table_counts",
    """SELECT 'objects' AS table_name, count(*) AS n_rows FROM b_objects
       UNION ALL SELECT 'channels', count(*) FROM b_channels
       UNION ALL SELECT 'alarms', count(*) FROM o_alarms
       UNION ALL SELECT 'hourly', count(*) FROM (
           SELECT DISTINCT e.channel_id, date_trunc('hour', e.event_ts) FROM b_events e
           JOIN b_channels c ON c.id = e.channel_id WHERE c.sensor_type IN ('temp', 'heat', 'flood', 'pump', 'fan')) h""",
)
def table_counts(t: Tables):
    return marts.table_counts({
        "objects": t.objects, "channels": t.channels, "alarms": marts.alarm_mart(t.events),
        "hourly": marts.hourly_mart(t.events, t.channels, CONFIG),
    })


@query(
    "weather_rows",
    "SELECT day, temp_mean, precipitation_mm, CASE WHEN day < DATE '2024-01-20' THEN humidity END AS humidity "
    "FROM b_weather",
)
def weather(t: Tables):
    """Weather packed into one payload of parallel arrays per run, with a short humidity array, and unpacked again."""
    day = F.struct("day", "temp_mean", "precipitation_mm", "humidity")
    packed = t.weather.withColumn("_m", F.trunc("day", "month")).groupBy("_m").agg(
        F.array_sort(F.collect_list(day)).alias("d")
    )
    early = F.filter("d", lambda x: x["day"] < F.lit("2024-01-20").cast("date"))
    daily = F.struct(
        F.transform("d", lambda x: x["day"].cast("string")).alias("time"),
        F.transform("d", lambda x: x["temp_mean"]).alias("temperature_2m_mean"),
        F.transform("d", lambda x: x["precipitation_mm"]).alias("precipitation_sum"),
        F.transform(early, lambda x: x["humidity"]).alias("relative_humidity_2m_mean"),
    )
    options = {"ignoreNullFields": "false"}
    return weather_rows(packed.select(F.to_json(F.struct(daily.alias("daily")), options).alias("payload")))


# ---- profiling ------------------------------------------------------------------------------------------------------


@query(
    "object_summary",
    "SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT kind) AS n_kinds FROM b_objects",
)
def object_summary(t: Tables):
    return profiling.object_summary(t.objects)


@query("objects_by_kind", "SELECT kind, level, count(*) AS n FROM b_objects GROUP BY ALL")
def objects_by_kind(t: Tables):
    return profiling.objects_by_kind(t.objects)


@query(
    "channel_summary",
    """SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT object_id) AS n_objects,
              count(DISTINCT system_type) AS n_systems, count(DISTINCT sensor_type) AS n_types FROM b_channels""",
)
def channel_summary(t: Tables):
    return profiling.channel_summary(t.channels)


@query("channels_by_system", "SELECT system_type, count(*) AS n FROM b_channels GROUP BY ALL")
def channels_by_system(t: Tables):
    return profiling.channels_by(t.channels, "system_type")


@query("channels_by_type", "SELECT sensor_type, system_type, count(*) AS n FROM b_channels GROUP BY ALL")
def channels_by_type(t: Tables):
    return profiling.channels_by(t.channels, "sensor_type", "system_type")


@query(
    "journal_summary",
    f"""SELECT count(*) AS n_rows, CAST(min(event_ts) AS DATE) AS date_min, CAST(max(event_ts) AS DATE) AS date_max,
               count(DISTINCT channel_id) AS n_channels, count_if(is_alarm) AS n_alarms,
               {rd('CAST(count_if(is_alarm) AS DOUBLE) / count(*)', 'alarm_share')} FROM o_norm""",
)
def journal_summary(t: Tables):
    return profiling.journal_summary(normalize.normalize_events(t.journal_raw))


@query(
    "journal_summary_by_year",
    f"""SELECT CAST(extract(year FROM event_ts) AS INTEGER) AS year, count(*) AS n_rows,
               CAST(min(event_ts) AS DATE) AS date_min, CAST(max(event_ts) AS DATE) AS date_max,
               count(DISTINCT channel_id) AS n_channels, count_if(is_alarm) AS n_alarms,
               {rd('CAST(count_if(is_alarm) AS DOUBLE) / count(*)', 'alarm_share')} FROM b_events GROUP BY 1""",
)
def journal_summary_by_year(t: Tables):
    return profiling.journal_summary(t.events.withColumn("year", F.year("event_ts")), "year")


_BY_TYPE = """SELECT coalesce(c.sensor_type, 'НЕТ В СПРАВОЧНИКЕ') AS sensor_type,
                     coalesce(c.system_type, '—') AS system_type, count(*) AS n_events,
                     count_if(is_alarm) AS n_alarms
              FROM o_norm e LEFT JOIN b_channels c ON c.id = e.channel_id GROUP BY ALL"""


@query("events_by_type", _BY_TYPE)
def events_by_type(t: Tables):
    return profiling.events_by_type(normalize.normalize_events(t.journal_raw), t.channels, CONFIG)


@query("alarms_by_type", f"SELECT * FROM ({_BY_TYPE}) a WHERE n_alarms > 0")
def alarms_by_type(t: Tables):
    return profiling.alarms_by_type(events_by_type(t))


@query(
    "top_alarm_channels",
    """SELECT a.channel_id, a.n, c.sensor_type, c.system_type, c.name, c.object_id
       FROM (SELECT channel_id, count(*) AS n FROM o_norm WHERE is_alarm GROUP BY channel_id
             ORDER BY n DESC, channel_id LIMIT 15) a LEFT JOIN b_channels c ON c.id = a.channel_id""",
)
def top_alarm_channels(t: Tables):
    return profiling.top_alarm_channels(normalize.normalize_events(t.journal_raw), t.channels)


@query(
    "orphans",
    """SELECT (SELECT count(DISTINCT channel_id) FROM o_norm
               WHERE channel_id NOT IN (SELECT id FROM b_channels)) AS orphan_channels,
              (SELECT count(DISTINCT object_id) FROM b_channels
               WHERE object_id NOT IN (SELECT id FROM b_objects)) AS orphan_objects""",
)
def orphans(t: Tables):
    return profiling.orphan_counts(normalize.normalize_events(t.journal_raw), t.channels, t.objects)


@query(
    "category_values",
    """SELECT c.sensor_type, e.value_cat, e.is_alarm, count(*) AS n
       FROM b_events e JOIN b_channels c ON c.id = e.channel_id WHERE value_cat IS NOT NULL
       GROUP BY ALL HAVING count(*) > 50""",
)
def category_values(t: Tables):
    return profiling.category_values(t.events, t.channels)


@query(
    "numeric_ranges",
    f"""SELECT c.sensor_type, count(*) AS n, min(value_num) AS value_min, {rd('avg(value_num)', 'value_mean')},
               max(value_num) AS value_max
        FROM b_events e JOIN b_channels c ON c.id = e.channel_id WHERE value_num IS NOT NULL GROUP BY c.sensor_type""",
)
def numeric_ranges(t: Tables):
    return profiling.numeric_ranges(t.events, t.channels)
