"""Texts shown to the dispatcher. The wording is fixed; only the assembly lives here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undercroft.config import FLOOD_MONTHS, HEATING_MONTHS, RECOMMENDATIONS, RISK_TITLES, SEASON_BOOST


def lookup(column: Column, table: dict[str, str], fallback: Column | None = None) -> Column:
    """Text of a code from a small fixed table, else `fallback` (the code itself by default)."""
    items = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*items)[column], column if fallback is None else fallback)


def risk_title(risk: Column) -> Column:
    return lookup(risk, RISK_TITLES)


def recommendation(risk: Column) -> Column:
    return lookup(risk, RECOMMENDATIONS, F.lit(None).cast("string"))


def _has(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)) != 0


def alarm_explanation(
    risk: Column, events: Column, channels: Column, pickets: Column, samples: Column, month: Column
) -> Column:
    """Why the alarm rules opened a prediction; parts that do not apply are NULL and skipped."""
    heated = [r for r, (months, _) in SEASON_BOOST.items() if months == HEATING_MONTHS]
    return F.concat_ws(
        " ",
        F.concat(risk_title(risk), F.lit(" на 24ч (правила по журналу тревог).")),
        F.concat(F.lit("событий: "), events.cast("string"), F.lit(", каналов: "), channels.cast("string"), F.lit(".")),
        F.when(pickets > 0, F.concat(F.lit("пикетов: "), pickets.cast("string"), F.lit("."))),
        F.when((risk == "intrusion") & (channels <= 1), F.lit("одиночная сработка — чаще ложная, сверить охрану.")),
        F.when((risk == "flood") & month.isin(*FLOOD_MONTHS), F.lit("сезон паводков/ливней.")).when(
            risk.isin(*heated) & month.isin(*HEATING_MONTHS), F.lit("отопительный сезон.")
        ),
        F.when(
            F.size(samples) > 0,
            F.concat(F.lit("примеры: "), F.array_join(F.slice(samples, 1, 3), "; "), F.lit(".")),
        ),
    )


def model_explanation(risk: Column, top_features: Column) -> Column:
    """Why the model opened a prediction, from the panel row's own measures and the model's leading features."""

    def counted(name: str, label: str) -> Column:
        measure = F.col(name)
        return F.when(
            (risk == name.split("_")[0]) & _has(measure),
            F.concat(F.lit(f"{label}: "), measure.cast("bigint").cast("string"), F.lit(".")),
        )

    return F.concat_ws(
        " ",
        F.concat(risk_title(risk), F.lit(" на 24ч.")),
        counted("fire_24h", "пожарных сработок за сутки"),
        counted("flood_24h", "водяных событий за сутки"),
        F.when(
            (risk == "flood") & F.col("precip").isNotNull(),
            F.concat(F.lit("осадки: "), F.format_string("%.1f", F.col("precip")), F.lit(" мм.")),
        ),
        counted("failure_new_24h", "новых отказов за сутки"),
        F.when(risk == "intrusion", F.when(_has(F.col("guard_on")), "на охране.").otherwise("снято с охраны.")),
        counted("intrusion_24h", "охранных тревог за сутки"),
        F.when((risk == "flood") & _has(F.col("flood_season")), F.lit("сезон паводков/ливней.")),
        F.when((risk == "failure") & _has(F.col("heating_season")), F.lit("отопительный сезон.")),
        F.when(
            F.size(top_features) > 0,
            F.concat(F.lit("ключевые признаки: "), F.array_join(F.slice(top_features, 1, 3), ", "), F.lit(".")),
        ),
    )
