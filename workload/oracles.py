"""Independent SQL for every checked query, over the same bound views.

The panel is written on purpose in another way than the engine computes it: windows as self-joins over hour ranges,
new failures as NOT EXISTS, the grid as a cross join.
"""

from __future__ import annotations

import re

from undercroft.config import DECISION_TITLES, RECOMMENDATIONS, RISK_TITLES, RISKS
from workload.binding import VIEWS


# Decimals compared. Means of two-decimal values over small counts end within nine digits, so rounding meets no ties.
DIGITS = 9


def rd(expr: str, name: str | None = None) -> str:
    """Rounded to DIGITS, without a negative zero."""
    text = f"CASE WHEN round({expr}, {DIGITS}) = 0 THEN 0.0 ELSE round({expr}, {DIGITS}) END"
    return f"{text} AS {name}" if name else text


def case_of(column: str, table: dict[str, str], fallback: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {fallback} END"


FIRE = "((st IN ('smoke', 'gas') AND w = 'error') OR (st = 'heat' AND w = 'purchase'))"
FLOOD = "((st = 'pump' AND w = 'error') OR (st = 'flood' AND w = 'purchase'))"
FAILURE = "(w = 'fault' OR (st = 'temp' AND (v < 0.5 OR v > 200)))"
INTRUSION = "((st = 'motion' AND is_alarm) OR (st = 'fan' AND w = 'fault'))"
CLASSIFY = (
    f"CASE WHEN st IS NULL THEN NULL WHEN {FIRE} THEN 'fire' WHEN {FLOOD} THEN 'flood' "
    "WHEN w = 'fault' THEN 'failure' WHEN st = 'motion' THEN 'intrusion' END"
)
NUM = r"'\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*'"

PANEL_HOURLY = (
    "n_events", "n_channels_active", "n_alarms", "n_fire", "n_flood", "n_failure", "n_failure_new", "n_intrusion",
    "n_fire_clean", "n_flood_clean", "n_fire_pickets", "n_intrusion_channels", "n_pump_on", "n_fan_on",
    "max_events_per_channel",
)


def _past(agg: str, column: str, hours: int, name: str, zero: bool = True) -> str:
    text = f"{agg}(x.{column}) FILTER (WHERE x.h > g.h - INTERVAL {hours} HOUR)"
    text = f"coalesce({text}, 0)" if zero else text
    return f"CAST({text} AS BIGINT) AS {name}" if zero else f"{text} AS {name}"


_PAST = ",\n".join(
    [
        _past("sum", f"n_{src}", hours, f"{name}_{hours}h")
        for name, src in (
            ("ev", "events"), ("al", "alarms"), ("fire", "fire"), ("flood", "flood"), ("failure", "failure"),
            ("intrusion", "intrusion"),
        )
        for hours in (1, 6, 24)
    ]
    + [
        _past("sum", "n_failure_new", 24, "failure_new_24h"),
        _past("max", "n_fire_pickets", 6, "fire_pickets_6h"),
        _past("max", "n_intrusion_channels", 6, "intrusion_channels_6h"),
        _past("sum", "n_pump_on", 6, "pump_on_6h"),
        _past("sum", "n_pump_on", 24, "pump_on_24h"),
        _past("sum", "n_fan_on", 24, "fan_on_24h"),
        _past("max", "max_events_per_channel", 24, "chatter_max_24h"),
        _past("sum", "n_channels_active", 24, "channel_touches_24h"),
        _past("avg", "temp_mean", 6, "temp_mean_6h", False),
        _past("avg", "temp_mean", 24, "temp_mean_24h", False),
        _past("max", "temp_max", 6, "temp_max_6h", False),
        _past("max", "temp_max", 24, "temp_max_24h", False),
        _past("min", "temp_min", 24, "temp_min_24h", False),
        _past("avg", "gas_mean", 24, "gas_mean_24h", False),
        _past("max", "gas_max", 6, "gas_max_6h", False),
        _past("max", "gas_max", 24, "gas_max_24h", False),
    ]
)
_AHEAD = ",\n".join(
    f"CAST(coalesce(sum(x.{src}), 0) AS BIGINT) AS y_{risk}_cnt"
    for risk, src in (
        ("fire", "n_fire_clean"), ("flood", "n_flood_clean"), ("failure", "n_failure_new"),
        ("intrusion", "n_intrusion"),
    )
)

# Shared sub-queries; each oracle pulls in the ones it names.
CTES: dict[str, str] = {
    **VIEWS,
    "o_alarms": """
        SELECT event_id, channel_id, event_ts, value_raw, value_num, value_cat FROM b_events WHERE is_alarm
    """,
    "o_mart_channels": r"""
        SELECT id, system_type, sensor_type, tag, name, object_id,
               nullif(regexp_extract(name, 'ПК\s*(\d+(?:[.,+]\d+)*)', 1), '') AS picket
        FROM b_channels
    """,
    "o_flag": rf"""
        SELECT *, coalesce({FIRE}, false) AS fire, coalesce({FLOOD}, false) AS flood,
               coalesce({FAILURE}, false) AS failure, coalesce({INTRUSION}, false) AS intrusion
        FROM (SELECT e.event_id, e.channel_id, c.object_id, c.sensor_type AS st,
                     regexp_extract(c.name, 'ПК\s*(\d+)', 1) AS pk, e.is_alarm,
                     date_trunc('hour', e.event_ts) AS h, e.value_num AS v, e.value_cat AS w
              FROM b_events e JOIN b_channels c ON c.id = e.channel_id WHERE c.object_id IS NOT NULL) j
    """,
    "o_noisy": """
        SELECT channel_id, count_if(fire) > 15 AS noisy_fire, count_if(flood) > 15 AS noisy_flood
        FROM o_flag GROUP BY channel_id
    """,
    "o_fail": "SELECT DISTINCT channel_id, object_id, h FROM o_flag WHERE failure",
    "o_newfail": """
        SELECT f.channel_id, f.object_id, f.h FROM o_fail f
        WHERE NOT EXISTS (SELECT 1 FROM o_fail p WHERE p.channel_id = f.channel_id AND p.h < f.h
                          AND p.h >= f.h - INTERVAL 24 HOUR)
    """,
    "o_hour": """
        SELECT o.*, m.max_events_per_channel, coalesce(nf.n, 0) AS n_failure_new
        FROM (SELECT f.object_id, f.h, count(*) AS n_events, count(DISTINCT f.channel_id) AS n_channels_active,
                     count_if(is_alarm) AS n_alarms, count_if(fire) AS n_fire, count_if(flood) AS n_flood,
                     count_if(failure) AS n_failure, count_if(intrusion) AS n_intrusion,
                     count_if(fire AND NOT noisy_fire) AS n_fire_clean,
                     count_if(flood AND NOT noisy_flood) AS n_flood_clean,
                     count(DISTINCT pk) FILTER (WHERE fire) AS n_fire_pickets,
                     count(DISTINCT f.channel_id) FILTER (WHERE intrusion) AS n_intrusion_channels,
                     count_if(st = 'pump' AND w = 'view') AS n_pump_on,
                     count_if(st = 'fan' AND w = 'view') AS n_fan_on,
                     avg(v) FILTER (WHERE st = 'temp' AND v BETWEEN 0.5 AND 200) AS temp_mean,
                     max(v) FILTER (WHERE st = 'temp' AND v BETWEEN 0.5 AND 200) AS temp_max,
                     min(v) FILTER (WHERE st = 'temp' AND v BETWEEN 0.5 AND 200) AS temp_min,
                     avg(v) FILTER (WHERE st = 'gas') AS gas_mean, max(v) FILTER (WHERE st = 'gas') AS gas_max,
                     max(CASE WHEN w = 'click' THEN 1 ELSE 0 END) FILTER (WHERE st = 'guard') AS guard_state
              FROM o_flag f JOIN o_noisy n ON n.channel_id = f.channel_id GROUP BY f.object_id, f.h) o
        JOIN (SELECT object_id, h, max(n) AS max_events_per_channel
              FROM (SELECT object_id, h, channel_id, count(*) AS n FROM o_flag GROUP BY ALL) c GROUP BY ALL) m
          ON m.object_id = o.object_id AND m.h = o.h
        LEFT JOIN (SELECT object_id, h, count(*) AS n FROM o_newfail GROUP BY ALL) nf
          ON nf.object_id = o.object_id AND nf.h = o.h
    """,
    "o_grid": """
        SELECT l.object_id, s.h, s.last_h
        FROM (SELECT object_id FROM o_hour GROUP BY object_id HAVING sum(n_events) >= 20) l
        CROSS JOIN (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h, max(h) AS last_h
                    FROM o_hour) s
    """,
    "o_caps": r"""
        SELECT object_id, count(*) AS n_channels, count_if(sensor_type = 'smoke') AS n_smoke,
               count_if(sensor_type = 'heat') AS n_heat, count_if(sensor_type = 'pump') AS n_pump,
               count_if(sensor_type = 'flood') AS n_flood_sensor, count_if(sensor_type = 'temp') AS n_temp,
               count_if(sensor_type = 'gas') AS n_gas, count_if(sensor_type IN ('motion', 'guard')) AS n_guard,
               count(DISTINCT nullif(regexp_extract(name, 'ПК\s*(\d+)', 1), '')) AS n_pickets
        FROM b_channels WHERE object_id IS NOT NULL GROUP BY object_id
    """,
    "o_past": f"""
        SELECT g.object_id, g.h, {_PAST}
        FROM o_grid g LEFT JOIN o_hour x ON x.object_id = g.object_id AND x.h <= g.h AND x.h > g.h - INTERVAL 24 HOUR
        GROUP BY g.object_id, g.h
    """,
    "o_ahead": f"""
        SELECT g.object_id, g.h, {_AHEAD}
        FROM o_grid g LEFT JOIN o_hour x ON x.object_id = g.object_id AND x.h > g.h AND x.h <= g.h + INTERVAL 24 HOUR
        GROUP BY g.object_id, g.h
    """,
    "o_guard": """
        SELECT g.object_id, g.h, coalesce(x.guard_state, 0) AS guard_on
        FROM o_grid g ASOF LEFT JOIN (SELECT object_id, h, guard_state FROM o_hour WHERE guard_state IS NOT NULL) x
          ON x.object_id = g.object_id AND g.h >= x.h
    """,
    "o_panel": f"""
        SELECT 2024 AS period, g.object_id, g.h AS hour_ts, CAST(g.h AS DATE) AS day,
               CAST(extract(hour FROM g.h) AS INTEGER) AS hour_of_day,
               CAST(extract(dow FROM g.h) AS INTEGER) AS day_of_week,
               CAST(extract(month FROM g.h) AS INTEGER) AS month,
               sin(2 * pi() * extract(month FROM g.h) / 12) AS month_sin,
               cos(2 * pi() * extract(month FROM g.h) / 12) AS month_cos,
               CASE WHEN extract(month FROM g.h) BETWEEN 3 AND 8 THEN 1 ELSE 0 END AS flood_season,
               CASE WHEN extract(month FROM g.h) IN (1, 2, 11, 12) THEN 1 ELSE 0 END AS heating_season,
               c.* EXCLUDE (object_id), p.* EXCLUDE (object_id, h), q.guard_on,
               CASE WHEN p.channel_touches_24h > 0
                    THEN CAST(p.ev_24h AS DOUBLE) / p.channel_touches_24h END AS events_per_channel_24h,
               p.temp_mean_6h - p.temp_mean_24h AS temp_trend,
               m.temp_mean AS temp_out, m.precipitation_mm AS precip, m.humidity,
               a.* EXCLUDE (object_id, h),
               {", ".join(f"CASE WHEN a.y_{r}_cnt > 0 THEN 1 ELSE 0 END AS y_{r}" for r in RISKS)}
        FROM o_grid g
        JOIN o_past p ON p.object_id = g.object_id AND p.h = g.h
        JOIN o_ahead a ON a.object_id = g.object_id AND a.h = g.h
        JOIN o_guard q ON q.object_id = g.object_id AND q.h = g.h
        JOIN o_caps c ON c.object_id = g.object_id
        LEFT JOIN b_weather m ON m.day = CAST(g.h AS DATE)
        WHERE g.h <= g.last_h - INTERVAL 24 HOUR
    """,
    "o_latest": "SELECT * FROM o_panel WHERE hour_ts = (SELECT max(hour_ts) FROM o_panel)",
    "o_scores": " UNION ALL ".join(
        f"""SELECT 'all' AS split, 'persist' AS method, '{r}' AS risk, object_id, hour_ts, y_{r} AS y,
                   CAST({r}_24h AS DOUBLE) / (CAST({r}_24h AS DOUBLE) + 3) AS score FROM o_panel"""
        for r in RISKS
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT 'all', 'rules', '{r}', object_id, hour_ts, y_{r},
                   CASE WHEN {rule} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM o_panel"""
        for r, rule in (
            ("fire", "fire_24h > 0 OR ((fire_pickets_6h >= 2 OR fire_6h >= 2) AND "
                     "(coalesce(temp_max_6h, 0) >= 40 OR coalesce(gas_max_6h, 0) >= 5))"),
            ("flood", "flood_24h > 0 OR (pump_on_24h >= 8 AND coalesce(precip, 0) >= 3)"),
            ("failure", "failure_new_24h > 0 OR chatter_max_24h >= 40 OR failure_24h >= 5"),
            ("intrusion", "(intrusion_24h > 0 AND guard_on >= 1) OR intrusion_channels_6h >= 2"),
        )
    ),
    # Every distinct score with everything at or above it, by a plain comparison join.
    "o_cells": """
        SELECT split, method, risk, score, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n
        FROM o_scores GROUP BY ALL
    """,
    "o_curve": """
        SELECT a.split, a.method, a.risk, a.score AS threshold, any_value(a.pos) AS pos,
               CAST(sum(b.pos) FILTER (WHERE b.score >= a.score) AS BIGINT) AS tp,
               CAST(sum(b.n) FILTER (WHERE b.score >= a.score) AS BIGINT) AS predicted,
               CAST(sum(b.pos) AS BIGINT) AS n_pos, CAST(sum(b.n) AS BIGINT) AS n_rows
        FROM o_cells a JOIN o_cells b ON a.split = b.split AND a.method = b.method AND a.risk = b.risk
        GROUP BY a.split, a.method, a.risk, a.score
    """,
    "o_pr": """
        SELECT *, CAST(tp AS DOUBLE) / predicted AS precision,
               CASE WHEN n_pos > 0 THEN CAST(tp AS DOUBLE) / n_pos ELSE 1.0 END AS recall
        FROM o_curve
    """,
    "o_ap": """
        SELECT split, method, risk,
               CASE WHEN max(n_pos) = 0 OR max(n_pos) = max(n_rows) THEN 0.0
                    ELSE sum(CAST(pos AS DOUBLE) / nullif(n_pos, 0) * precision) END AS pr_auc
        FROM o_pr GROUP BY ALL
    """,
    "o_thr": """
        SELECT split, method, risk, threshold FROM (
            SELECT *, row_number() OVER (
                PARTITION BY split, method, risk ORDER BY met DESC,
                CASE WHEN (risk <> 'intrusion') = met THEN precision ELSE recall END DESC, threshold) AS rn
            FROM (SELECT *, CASE risk WHEN 'failure' THEN recall >= 0.6 WHEN 'intrusion' THEN precision >= 0.8
                                      ELSE recall >= 0.7 END AS met FROM o_pr) m) r
        WHERE rn = 1
    """,
    "o_fixed_thr": """
        SELECT split, method, risk, CASE WHEN method = 'rules' THEN 0.5 ELSE threshold END AS threshold FROM o_thr
    """,
    "o_metrics": """
        SELECT s.split, s.method, s.risk, any_value(t.threshold) AS threshold,
               coalesce(CAST(count_if(score >= threshold AND y = 1) AS DOUBLE)
                        / nullif(count_if(score >= threshold), 0), 0) AS precision,
               coalesce(CAST(count_if(score >= threshold AND y = 1) AS DOUBLE) / nullif(sum(y), 0), 0) AS recall,
               count_if(score >= threshold) AS positives_pred, CAST(sum(y) AS BIGINT) AS positives_true,
               count(*) AS n, any_value(a.pr_auc) AS pr_auc
        FROM o_scores s JOIN o_fixed_thr t ON t.split = s.split AND t.method = s.method AND t.risk = s.risk
        JOIN o_ap a ON a.split = s.split AND a.method = s.method AND a.risk = s.risk
        GROUP BY s.split, s.method, s.risk
    """,
    "o_recent": f"""
        SELECT *, {CLASSIFY} AS risk_type
        FROM (SELECT a.*, c.object_id, c.sensor_type AS st, a.value_cat AS w, c.picket
              FROM o_alarms a JOIN o_mart_channels c ON c.id = a.channel_id
              WHERE c.object_id IS NOT NULL
                AND a.event_ts >= (SELECT max(event_ts) FROM o_alarms) - INTERVAL 24 HOUR) j
    """,
    "o_buckets": """
        SELECT b.*, s.samples FROM (
            SELECT object_id, risk_type, count(*) AS n_events, count(DISTINCT channel_id) AS n_channels,
                   count(DISTINCT nullif(picket, '')) AS n_pickets, min(channel_id) AS channel_id
            FROM o_recent WHERE risk_type IS NOT NULL GROUP BY ALL) b
        JOIN (SELECT object_id, risk_type, string_agg(txt, '; ' ORDER BY rn) AS samples
              FROM (SELECT object_id, risk_type,
                           st || '=' || coalesce(nullif(w, ''), value_raw, 'None') || ' @ '
                           || strftime(event_ts, '%Y-%m-%dT%H:%M') AS txt,
                           row_number() OVER (PARTITION BY object_id, risk_type ORDER BY event_ts, event_id) AS rn
                    FROM o_recent WHERE risk_type IS NOT NULL) t
              WHERE rn <= 4 GROUP BY ALL) s
          ON s.object_id = b.object_id AND s.risk_type = b.risk_type
    """,
    "o_rule_preds": f"""
        SELECT object_id, channel_id, risk_type,
               round(least(0.97, score + CASE WHEN risk_type = 'flood' AND m BETWEEN 3 AND 8 THEN 0.04
                    WHEN risk_type = 'failure' AND m IN (11, 12, 1, 2) THEN 0.03
                    WHEN risk_type = 'fire' AND m IN (11, 12, 1, 2) THEN 0.02 ELSE 0 END), 3) AS probability,
               24 AS horizon_hours,
               {case_of('risk_type', RISK_TITLES)} || ' на 24ч (правила по журналу тревог). событий: ' || n_events
               || ', каналов: ' || n_channels || '.'
               || CASE WHEN n_pickets > 0 THEN ' пикетов: ' || n_pickets || '.' ELSE '' END
               || CASE WHEN risk_type = 'intrusion' AND n_channels <= 1
                       THEN ' одиночная сработка — чаще ложная, сверить охрану.' ELSE '' END
               || CASE WHEN risk_type = 'flood' AND m BETWEEN 3 AND 8 THEN ' сезон паводков/ливней.'
                       WHEN risk_type IN ('fire', 'failure') AND m IN (11, 12, 1, 2) THEN ' отопительный сезон.'
                       ELSE '' END
               || ' примеры: ' || array_to_string(string_split(samples, '; ')[1:3], '; ') || '.' AS explanation,
               {case_of('risk_type', RECOMMENDATIONS)} AS recommendation, 'open' AS status, 'rules' AS source
        FROM (SELECT *, month((SELECT max(event_ts) FROM o_alarms)) AS m,
                     CASE WHEN risk_type = 'intrusion' AND n_channels <= 1 THEN least(base, 0.68)
                          WHEN risk_type = 'fire' AND n_pickets >= 2 THEN greatest(base, 0.78)
                          WHEN risk_type = 'flood' AND n_events >= 2 THEN greatest(base, 0.74)
                          ELSE base END AS score
              FROM (SELECT *, 0.52::DOUBLE + 0.08::DOUBLE * least(n_events, 6) + 0.05::DOUBLE * least(n_channels, 4)
                              + 0.06::DOUBLE * least(n_pickets, 3) AS base FROM o_buckets) b) s
    """,
    "o_feedback_n": """
        SELECT p.risk_type, f.decision, count(*) AS n
        FROM b_feedback f JOIN b_predictions p ON p.id = f.prediction_id GROUP BY ALL
    """,
    "o_base_thr": "SELECT unnest(['fire', 'flood', 'failure', 'intrusion']) AS risk_type, 0.5::DOUBLE AS threshold",
    "o_calibrated": """
        SELECT risk_type, round(threshold, 3) AS base_threshold,
               round(least(0.95, greatest(0.05, threshold + s)), 3) AS threshold, round(s, 3) AS shift,
               n_dispatch, n_false_alarm
        FROM (SELECT *, greatest(-0.15::DOUBLE, least(0.15::DOUBLE, 0.025::DOUBLE * n_false_alarm
                     - 0.012::DOUBLE * n_dispatch)) AS s
              FROM (SELECT b.risk_type, any_value(b.threshold) AS threshold,
                           CAST(coalesce(sum(n) FILTER (WHERE decision = 'false_alarm'), 0) AS BIGINT) AS n_false_alarm,
                           CAST(coalesce(sum(n) FILTER (WHERE decision IN ('dispatch', 'maintenance')), 0) AS BIGINT)
                               AS n_dispatch
                    FROM o_base_thr b LEFT JOIN o_feedback_n f ON f.risk_type = b.risk_type
                    GROUP BY b.risk_type) c) d
    """,
    "o_pickets": """
        SELECT object_id, coalesce(nullif(picket, ''), 'без пикета') AS picket, count(*) AS n_channels,
               array_to_string(list_sort(list(DISTINCT sensor_type))[1:8], ',') AS sensor_types,
               bool_or(sensor_type IN ('smoke', 'heat', 'gas')) AS has_fire,
               bool_or(sensor_type IN ('flood', 'pump')) AS has_flood,
               bool_or(sensor_type = 'motion') AS has_guard,
               TRY_CAST(nullif(regexp_extract(coalesce(picket, ''), '(\\d+)', 1), '') AS BIGINT) AS picket_no
        FROM o_mart_channels WHERE object_id IS NOT NULL GROUP BY ALL
    """,
    "o_named_alarms": f"""
        SELECT event_id, event_ts, channel_id, object_id, object_name, st AS sensor_type, picket, value_raw,
               value_cat, {CLASSIFY} AS risk
        FROM (SELECT a.*, a.value_cat AS w, c.object_id, c.sensor_type AS st, c.picket, o.name AS object_name
              FROM o_alarms a LEFT JOIN o_mart_channels c ON c.id = a.channel_id
              LEFT JOIN b_objects o ON o.id = c.object_id) j
    """,
    "o_norm": rf"""
        SELECT * FROM (
            SELECT CASE WHEN regexp_full_match(event_id, '\d+') THEN CAST(event_id AS BIGINT) END AS event_id,
                   CASE WHEN regexp_full_match(channel_id, '\d+') THEN CAST(channel_id AS BIGINT) END AS channel_id,
                   TRY_CAST(date || ' ' || time AS TIMESTAMP) AS event_ts,
                   lower(alarm) IN ('t', 'true', '1') AS is_alarm, value AS value_raw,
                   CASE WHEN value LIKE '%01.01.1970%' THEN NULL
                        WHEN regexp_full_match(replace(value, ',', '.'), {NUM})
                        THEN CAST(replace(value, ',', '.') AS DOUBLE) END AS value_num,
                   CASE WHEN value LIKE '%01.01.1970%' OR regexp_full_match(replace(value, ',', '.'), {NUM})
                        THEN NULL ELSE value END AS value_cat
            FROM b_journal_raw) n
        WHERE event_id IS NOT NULL AND channel_id IS NOT NULL
    """,
    "o_lenient": rf"""
        SELECT * FROM (
            SELECT CASE WHEN regexp_full_match(event_id, '\d+') THEN CAST(event_id AS BIGINT) END AS event_id,
                   CASE WHEN regexp_full_match(channel_id, '\d+') THEN CAST(channel_id AS BIGINT) END AS channel_id,
                   CASE WHEN time IS NULL THEN CAST(date AS TIMESTAMP)
                        ELSE CAST(date || ' ' || time AS TIMESTAMP) END AS event_ts,
                   coalesce(lower(trim(alarm)) IN ('t', 'true', '1', 'yes'), false) AS is_alarm, value AS value_raw,
                   CASE WHEN value LIKE '%01.01.1970%' THEN NULL
                        WHEN regexp_full_match(replace(value, ',', '.'), {NUM})
                        THEN CAST(replace(value, ',', '.') AS DOUBLE) END AS value_num,
                   CASE WHEN value LIKE '%01.01.1970%' OR regexp_full_match(replace(value, ',', '.'), {NUM})
                        THEN NULL ELSE nullif(trim(value), '') END AS value_cat
            FROM b_journal_raw) n
        WHERE event_id IS NOT NULL AND channel_id IS NOT NULL
    """,
    "o_base_doubled": """
        SELECT * FROM b_events
        UNION ALL
        SELECT event_id, channel_id, event_ts + INTERVAL 1 HOUR, is_alarm, value_raw, value_num, value_cat
        FROM b_events WHERE event_id % 10 = 0
    """,
}


def _plain_counts(text: str) -> str:
    """`count_if` gives a 128-bit integer in the checking engine; a counted CASE gives a 64-bit one."""
    while (at := text.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[:at]}count(CASE WHEN {text[at + len('count_if('):end - 1]} THEN 1 END){text[end:]}"
    return text


def build(body: str, extra: dict[str, str] | None = None) -> str:
    """A full statement: the body plus, in order, the shared sub-queries it needs."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(known[name])

    visit(body)
    # Definition order is not enough once `extra` refers both ways, so sort by dependency.
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in known:
            if other != name and other in needed and re.search(rf"\b{other}\b", known[name]):
                place(other)
        ordered.append(name)

    for name in known:
        if name in needed:
            place(name)
    head = ",\n".join(f"{n} AS ({known[n].strip()})" for n in ordered)
    return _plain_counts(f"WITH {head}\n{body.strip()}" if head else body.strip())
