"""Picket labels inside channel names. Three readers exist and must not be mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the naming scheme.
MART_PATTERN = r"ПК\s*(\d+(?:[.,+]\d+)*)"
PANEL_PATTERN = r"ПК\s*(\d+)"
UPLOAD_PATTERN = r"(?iu)ПК\s*(\d+(?:[.,+]\d+)*)"


def mart_picket(name: Column) -> Column:
    """Full label such as `12+5`; NULL when there is none."""
    return F.nullif(F.regexp_extract(name, MART_PATTERN, 1), F.lit(""))


def upload_picket(name: Column) -> Column:
    """As `mart_picket`, in any letter case."""
    return F.nullif(F.regexp_extract(name, UPLOAD_PATTERN, 1), F.lit(""))


def panel_picket(name: Column) -> Column:
    """Leading integer only; the empty text (not NULL) when a name has no picket."""
    return F.regexp_extract(name, PANEL_PATTERN, 1)


def picket_number(picket: Column) -> Column:
    """First number of a label, for natural order; NULL when the label has none."""
    return F.nullif(F.regexp_extract(picket, r"(\d+)", 1), F.lit("")).try_cast("bigint")
