"""Column expressions that read the journal's dirty text fields.

Two modes, as the journal has two readers: `strict` (bulk load) takes text as it is, `lenient` (upload and wire)
trims, drops inner spaces and accepts a date without a time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the journal format.
EPOCH_MARK = "01.01.1970"
TRUE_STRICT = ("t", "true", "1")
TRUE_LENIENT = ("t", "true", "1", "yes")

# Casting is guarded by these patterns because engines disagree on texts such as `1.0d`.
_DECIMAL = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
_PLAIN_NUMBER = r"^-?\d+(?:[.,]\d+)?$"
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_STAMP = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?$"
_STAMP_SECONDS = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_BLANKS = " \t\n\r\f\x0b"


def _lenient(mode: str) -> bool:
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be strict or lenient, got {mode!r}")
    return mode == "lenient"


def strip(text: Column) -> Column:
    """Trim any whitespace, not just spaces."""
    return F.btrim(text, F.lit(_BLANKS))


def to_long(text: Column) -> Column:
    """Whole number; Spark's try_cast already refuses texts such as `12.7`."""
    return text.try_cast("bigint")


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def alarm_flag(text: Column, mode: str = "strict") -> Column:
    if _lenient(mode):
        return F.coalesce(F.lower(strip(text)).isin(*TRUE_LENIENT), F.lit(False))
    return F.lower(text).isin(*TRUE_STRICT)


def is_epoch_junk(text: Column) -> Column:
    return text.contains(EPOCH_MARK)


def to_number(text: Column, mode: str = "strict") -> Column:
    """Number with a decimal point or comma; epoch junk and words give NULL."""
    cleaned = F.replace(text, F.lit(","), F.lit("."))
    if _lenient(mode):
        cleaned = F.replace(strip(cleaned), F.lit(" "), F.lit(""))
    return F.when(~is_epoch_junk(text) & cleaned.rlike(_DECIMAL), F.trim(cleaned).try_cast("double"))


def to_category(text: Column, number: Column, mode: str = "strict") -> Column:
    """The status word of a value that is neither a number nor epoch junk."""
    word = F.nullif(strip(text), F.lit("")) if _lenient(mode) else text
    return F.when(number.isNull() & ~is_epoch_junk(text), word)


def to_timestamp(date: Column, time: Column, mode: str = "strict") -> Column:
    """Zone-less timestamp from a date text and a time text.

    strict: any bad or missing half gives NULL. lenient: a bad or missing time means midnight.
    """
    if _lenient(mode):
        date, time = (F.btrim(strip(c), F.lit('"')) for c in (date, time))
        text = F.concat(date, F.lit(" "), time)
        full = F.when(text.rlike(_STAMP_SECONDS), text.try_cast("timestamp_ntz"))
        return F.coalesce(full, F.when(date.rlike(_DATE), date.try_cast("timestamp_ntz")))
    text = F.concat(F.trim(date), F.lit(" "), F.trim(time))
    return F.when(text.rlike(_STAMP), text.try_cast("timestamp_ntz"))


def value_kind(text: Column) -> Column:
    """empty | epoch_junk | numeric | categorical."""
    trimmed = strip(text)
    return (
        F.when(text.isNull() | (trimmed == ""), "empty")
        .when(is_epoch_junk(trimmed), "epoch_junk")
        .when(F.replace(trimmed, F.lit(" "), F.lit("")).rlike(_PLAIN_NUMBER), "numeric")
        .otherwise("categorical")
    )
