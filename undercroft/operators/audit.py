"""Run audit: one appended row per action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.operators.rows import hashed_id


def audit_rows(runs: DataFrame, action: str, login: Column, created_at: Column, *details: str) -> DataFrame:
    """Rows to append: who, what, when, and the given columns as a JSON text. The id comes from the content, so a
    repeated run appends the same rows."""
    text = F.to_json(F.struct(*details), {"ignoreNullFields": "false"})
    return runs.select(
        login.alias("user_login"), F.lit(action).alias("action"), text.alias("details"), created_at.alias("created_at")
    ).select(hashed_id(F.col("user_login"), F.col("action"), F.col("details"), F.col("created_at")).alias("id"), "*")
