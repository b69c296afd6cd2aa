"""Cells of pivoted tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def only(value: str | Column, what: str) -> Column:
    """Aggregate of the one row of a cell; several rows are an error, never a choice."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"several {what} for one cell"))).otherwise(F.first(value))
