"""Score expressions: persistence, dispatcher rules, alarm-rule probability, feedback shift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undercroft.config import SEASON_BOOST

# Fixed constants of the scoring rules.
PERSIST_HALF = 3.0
BASE, PER_EVENT, PER_CHANNEL, PER_PICKET = 0.52, 0.08, 0.05, 0.06
MAX_EVENTS, MAX_CHANNELS, MAX_PICKETS = 6, 4, 3
LONE_INTRUSION_CAP, MULTI_PICKET_FIRE_FLOOR, REPEATED_FLOOD_FLOOR, PROBABILITY_CAP = 0.68, 0.78, 0.74, 0.97
FALSE_STEP, DISPATCH_STEP, MAX_SHIFT = 0.025, 0.012, 0.15
THRESHOLD_MIN, THRESHOLD_MAX = 0.05, 0.95


def persist_score(risk: str) -> Column:
    """Share x / (x + 3) of the last day's events of a risk, within 0…1."""
    x = F.col(f"{risk}_24h").cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (x + F.lit(PERSIST_HALF))))


def _at_least(name: str, limit: float) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) >= limit


def _any(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) > 0


def rule_score(risk: str) -> Column:
    """Dispatcher rule of a risk as 0.0 / 1.0; a missing measure counts as 0."""
    rules = {
        "fire": lambda: _any("fire_24h")
        | ((_at_least("fire_pickets_6h", 2) | _at_least("fire_6h", 2))
           & (_at_least("temp_max_6h", 40) | _at_least("gas_max_6h", 5))),
        "flood": lambda: _any("flood_24h") | (_at_least("pump_on_24h", 8) & _at_least("precip", 3)),
        "failure": lambda: _any("failure_new_24h") | _at_least("chatter_max_24h", 40) | _at_least("failure_24h", 5),
        "intrusion": lambda: (_any("intrusion_24h") & _at_least("guard_on", 1))
        | _at_least("intrusion_channels_6h", 2),
    }
    return rules[risk]().cast("double")


def season_boost(risk: Column, month: Column) -> Column:
    boost = F.lit(0.0)
    for name, (months, value) in SEASON_BOOST.items():
        boost = F.when((risk == name) & month.isin(*months), value).otherwise(boost)
    return boost


def alarm_probability(risk: Column, events: Column, channels: Column, pickets: Column, month: Column) -> Column:
    """Probability of an incident from one day's alarms of an object."""
    score = (
        F.lit(BASE)
        + F.lit(PER_EVENT) * F.least(events, F.lit(MAX_EVENTS))
        + F.lit(PER_CHANNEL) * F.least(channels, F.lit(MAX_CHANNELS))
        + F.lit(PER_PICKET) * F.least(pickets, F.lit(MAX_PICKETS))
    )
    score = F.when((risk == "intrusion") & (channels <= 1), F.least(score, F.lit(LONE_INTRUSION_CAP))).otherwise(score)
    score = F.when((risk == "fire") & (pickets >= 2), F.greatest(score, F.lit(MULTI_PICKET_FIRE_FLOOR))).otherwise(score)
    score = F.when((risk == "flood") & (events >= 2), F.greatest(score, F.lit(REPEATED_FLOOD_FLOOR))).otherwise(score)
    return F.round(F.least(F.lit(PROBABILITY_CAP), score + season_boost(risk, month)), 3)


def feedback_shift(n_false: Column, n_dispatch: Column) -> Column:
    """False alarms raise a threshold, confirmed ones lower it a little."""
    raw = F.lit(FALSE_STEP) * n_false - F.lit(DISPATCH_STEP) * n_dispatch
    return F.greatest(F.lit(-MAX_SHIFT), F.least(F.lit(MAX_SHIFT), raw))


def shifted_threshold(base: Column, shift: Column) -> Column:
    return F.round(F.least(F.lit(THRESHOLD_MAX), F.greatest(F.lit(THRESHOLD_MIN), base + shift)), 3)
