"""Event predicates: what a journal row says about the four risks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from undercroft.config import RiskConfig


def _sure(condition: Column) -> Column:
    """NULL counts as no."""
    return F.coalesce(condition, F.lit(False))


def one_of(column: Column, values: Iterable[str]) -> Column:
    values = tuple(values)
    return _sure(column.isin(*values)) if values else F.lit(False)


def pair_in(sensor_type: Column, value: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """(sensor type, value) is one of `pairs`; grouped by type so that each type is compared once."""
    by_type: dict[str, list[str]] = {}
    for kind, word in pairs:
        by_type.setdefault(kind, []).append(word)
    found = F.lit(False)
    for kind, words in by_type.items():
        found = found | ((sensor_type == kind) & value.isin(*words))
    return _sure(found)


def intrusion(sensor_type: Column, value: Column, is_alarm: Column, cfg: RiskConfig) -> Column:
    guarded = one_of(sensor_type, cfg.intrusion_types) & _sure(is_alarm)
    return guarded | pair_in(sensor_type, value, cfg.intrusion_pairs)


def impossible_temperature(sensor_type: Column, number: Column, cfg: RiskConfig) -> Column:
    return one_of(sensor_type, cfg.temp_types) & _sure((number < cfg.temp_min) | (number > cfg.temp_max))


def event_flags(cfg: RiskConfig) -> dict[str, Column]:
    """Flags of one event with its channel's `sensor_type`; an event may carry several."""
    kind, word, number = F.col("sensor_type"), F.col("value_cat"), F.col("value_num")
    temperature = one_of(kind, cfg.temp_types) & _sure(number.between(cfg.temp_min, cfg.temp_max))
    return {
        "ev_fire": pair_in(kind, word, cfg.fire_pairs),
        "ev_flood": pair_in(kind, word, cfg.flood_pairs),
        "ev_failure": one_of(word, cfg.failure_values) | impossible_temperature(kind, number, cfg),
        "ev_intrusion": intrusion(kind, word, F.col("is_alarm"), cfg),
        "temp_val": F.when(temperature, number),
        "gas_val": F.when(one_of(kind, cfg.gas_types), number),
        "pump_on": _sure((kind == cfg.pump_type) & (word == cfg.on_value)),
        "fan_on": _sure((kind == cfg.fan_type) & (word == cfg.on_value)),
        "guard_set": _sure((kind == cfg.guard_type) & (word == cfg.guard_on_value)),
    }


def classify_event(sensor_type: Column, value: Column, cfg: RiskConfig) -> Column:
    """The single risk of an alarm, or NULL; the first matching risk wins.

    Unlike the panel's flags this ignores the alarm flag (marts hold alarms only) and temperatures.
    """
    return (
        F.when(sensor_type.isNull() | (sensor_type == ""), F.lit(None))
        .when(pair_in(sensor_type, value, cfg.fire_pairs), "fire")
        .when(pair_in(sensor_type, value, cfg.flood_pairs), "flood")
        .when(one_of(value, cfg.failure_values), "failure")
        .when(
            one_of(sensor_type, cfg.intrusion_types) | pair_in(sensor_type, value, cfg.intrusion_pairs),
            "intrusion",
        )
    )
