"""Hours as whole numbers and calendar features, free of any session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.config import FLOOD_MONTHS, HEATING_MONTHS

_EPOCH_DAY = dt.date(1970, 1, 1)
# A text, because a Python datetime would become an instant in the session zone.
_EPOCH = "1970-01-01 00:00:00"


def hour_number(ts: Column) -> Column:
    """Hours since 1970-01-01, as a long: cheap to group and window by."""
    return F.datediff(ts.cast("date"), F.lit(_EPOCH_DAY)).cast("bigint") * 24 + F.hour(ts)


def hour_timestamp(number: Column) -> Column:
    """Zone-less start of the hour with the given number."""
    return F.timestamp_add("HOUR", number.cast("int"), F.lit(_EPOCH).cast("timestamp_ntz"))


def day_of_week(ts: Column) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(ts) - 1


def season_features(month: Column) -> dict[str, Column]:
    """Cyclic month and the two season flags."""
    angle = F.lit(2.0) * F.pi() * month / F.lit(12.0)
    return {
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "flood_season": month.isin(*FLOOD_MONTHS).cast("int"),
        "heating_season": month.isin(*HEATING_MONTHS).cast("int"),
    }


def calendar_features(ts: Column) -> dict[str, Column]:
    return {
        "day": ts.cast("date"),
        "hour_of_day": F.hour(ts),
        "day_of_week": day_of_week(ts),
        "month": F.month(ts),
        **season_features(F.month(ts)),
    }


def with_season(frame: DataFrame) -> DataFrame:
    """Season features for a frame that has a month but was built without them; a missing month counts as 0."""
    if "month" not in frame.columns or "month_sin" in frame.columns:
        return frame
    return frame.withColumns(season_features(F.coalesce(F.col("month").try_cast("int"), F.lit(0))))
