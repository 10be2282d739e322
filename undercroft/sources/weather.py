"""Daily weather from the payload of the weather service: a struct of parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.schemas import WEATHER_PAYLOAD


def weather_rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON payload texts -> one row per day; an array shorter than the day list gives NULL.

    A payload without days fails the job, with the service's own reason when it gave one.
    """
    parsed = payloads.select(F.col(column).alias("text"), F.from_json(column, WEATHER_PAYLOAD).alias("p"))
    days = F.col("p.daily.time")
    empty = days.isNull() | (F.size(days) == 0)
    message = F.concat(F.lit("weather payload without days: "), F.coalesce("p.reason", "text", F.lit("empty")))
    # zip pads short arrays with NULL up to the longest one; only as many rows as there are days are kept.
    none = F.array().cast("array<double>")
    safe = F.struct(
        days.alias("time"),
        *[F.coalesce(F.col(f"p.daily.{c}"), none).alias(c) for c in (
            "temperature_2m_mean", "precipitation_sum", "relative_humidity_2m_mean")],
    )
    zipped = F.arrays_zip(
        safe["time"], safe["temperature_2m_mean"], safe["precipitation_sum"], safe["relative_humidity_2m_mean"]
    )
    rows = F.when(empty, F.raise_error(message)).otherwise(F.slice(zipped, 1, F.size(days)))
    names = ("day", "temp_mean", "precipitation_mm", "humidity")
    typed = "array<struct<day:string,temp_mean:double,precipitation_mm:double,humidity:double>>"
    return parsed.select(F.inline(rows.cast(typed))).select(F.to_date(names[0]).alias("day"), *names[1:])
