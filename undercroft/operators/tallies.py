"""Raw events -> one compact row per channel and hour, before any join.

The risk of an event depends on its channel's sensor type, which lives in the channel table. Joining that table to
the raw journal would shuffle the whole journal as soon as the table is too big to broadcast, and one chatty channel
would own a third of a partitioned join. So the journal is first reduced, with map-side combine, to type-agnostic
tallies per (period, channel, hour): one count per distinct rule of the vocabulary. The channel table then joins a
table of at most 8 784 rows per channel and year, and picks the tally that its sensor type stands for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.config import RiskConfig
from undercroft.functions.calendar import hour_number

PERIOD = "period"


def with_period(events: DataFrame) -> DataFrame:
    """Adds the period (the journal file's year) that no window crosses."""
    year = F.col("year") if "year" in events.columns else F.year("event_ts")
    return events.withColumn(PERIOD, year.cast("int"))


@dataclass(frozen=True)
class _Rule:
    """What makes an event count for a risk, for channels of certain sensor types."""

    words: frozenset[str] = frozenset()
    alarm: bool = False
    out_of_range: bool = False

    def condition(self, cfg: RiskConfig) -> Column | None:
        parts = []
        if self.words:
            parts.append(F.col("value_cat").isin(*sorted(self.words)))
        if self.alarm:
            parts.append(F.col("is_alarm"))
        if self.out_of_range:
            parts.append((F.col("value_num") < cfg.temp_min) | (F.col("value_num") > cfg.temp_max))
        if not parts:
            return None
        # NULL counts as no in every part, so that one unknown part cannot hide another.
        joined = F.coalesce(parts[0], F.lit(False))
        for part in parts[1:]:
            joined = joined | F.coalesce(part, F.lit(False))
        return joined


@dataclass
class _Risk:
    """Rules of one risk: by sensor type, and for every other type."""

    default: _Rule = _Rule()
    by_type: dict[str, _Rule] = field(default_factory=dict)

    def rules(self) -> list[_Rule]:
        ordered = [self.default, *self.by_type.values()]
        return list(dict.fromkeys(r for r in ordered if r != _Rule()))


def _words_by_type(pairs) -> dict[str, frozenset[str]]:
    out: dict[str, frozenset[str]] = {}
    for kind, word in pairs:
        out[kind] = out.get(kind, frozenset()) | {word}
    return out


def _risks(cfg: RiskConfig) -> dict[str, _Risk]:
    words = frozenset(cfg.failure_values)
    pairs = _words_by_type(cfg.intrusion_pairs)
    guarded = set(cfg.intrusion_types)
    return {
        "fire": _Risk(by_type={t: _Rule(w) for t, w in _words_by_type(cfg.fire_pairs).items()}),
        "flood": _Risk(by_type={t: _Rule(w) for t, w in _words_by_type(cfg.flood_pairs).items()}),
        "failure": _Risk(_Rule(words), {t: _Rule(words, out_of_range=True) for t in cfg.temp_types}),
        "intrusion": _Risk(
            by_type={t: _Rule(pairs.get(t, frozenset()), alarm=t in guarded) for t in sorted(guarded | set(pairs))}
        ),
    }


def channel_hour_tallies(events: DataFrame, cfg: RiskConfig, *more: Column) -> DataFrame:
    """(period, channel_id, hour_no) with one count per rule, mergeable sums of the measures, and `more` aggregates."""
    number = F.col("value_num")
    valid = F.when(number.between(cfg.temp_min, cfg.temp_max), number)
    counts = []
    for name, risk in _risks(cfg).items():
        for i, rule in enumerate(risk.rules()):
            counts.append(F.count_if(rule.condition(cfg)).alias(f"{name}_{i}"))
    return (
        with_period(events)
        .filter(F.col("event_ts").isNotNull())
        .groupBy(PERIOD, "channel_id", hour_number(F.col("event_ts")).alias("hour_no"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if("is_alarm").alias("n_alarms"),
            F.count_if(F.col("value_cat") == cfg.on_value).alias("n_on"),
            F.max((F.coalesce(F.col("value_cat"), F.lit("")) == cfg.guard_on_value).cast("int")).alias("guard_set"),
            F.sum(valid).alias("temp_sum"),
            F.count(valid).alias("temp_n"),
            F.max(valid).alias("temp_max"),
            F.min(valid).alias("temp_min"),
            F.sum(number).alias("num_sum"),
            F.count(number).alias("num_n"),
            F.max(number).alias("num_max"),
            *counts,
            *more,
        )
    )


def typed_channel_hours(tallies: DataFrame, channels: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Tallies read through each channel's sensor type; channels without an object are dropped.

    `channels` needs id, sensor_type, object_id and picket.
    """
    kind = F.col("sensor_type")

    def of_type(types, column: Column) -> Column:
        return F.when(kind.isin(*types), column)

    picked = []
    for name, risk in _risks(cfg).items():
        order = {rule: i for i, rule in enumerate(risk.rules())}

        def tally(rule: _Rule, name=name, order=order) -> Column:
            return F.col(f"{name}_{order[rule]}") if rule in order else F.lit(0).cast("bigint")

        value = tally(risk.default)
        for sensor, rule in risk.by_type.items():
            value = F.when(kind == sensor, tally(rule)).otherwise(value)
        picked.append(value.alias(f"n_{name}"))

    dims = channels.select(
        F.col("id").alias("channel_id"), "sensor_type", "object_id", F.col("picket").alias("picket")
    ).filter(F.col("object_id").isNotNull())
    zero = F.lit(0).cast("bigint")
    return tallies.join(dims, "channel_id").select(
        PERIOD,
        "channel_id",
        "hour_no",
        "object_id",
        "picket",
        "n_events",
        "n_alarms",
        *picked,
        F.coalesce(of_type([cfg.pump_type], F.col("n_on")), zero).alias("n_pump_on"),
        F.coalesce(of_type([cfg.fan_type], F.col("n_on")), zero).alias("n_fan_on"),
        of_type([cfg.guard_type], F.col("guard_set")).alias("guard_state"),
        *[of_type(cfg.temp_types, F.col(c)).alias(c) for c in ("temp_sum", "temp_n", "temp_max", "temp_min")],
        *[of_type(cfg.gas_types, F.col(f"num_{c}")).alias(f"gas_{c}") for c in ("sum", "n", "max")],
    )
