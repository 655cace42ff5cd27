"""Numeric expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cleaned_number(frame: DataFrame, name: str) -> Column:
    """The column as a number without its sign; other characters are dropped from text."""
    if isinstance(frame.schema[name].dataType, T.NumericType):
        return F.abs(F.col(name)).cast("double")
    return F.regexp_replace(F.col(name), "[^0-9.]", "").try_cast("double")


def count_where(condition: Column) -> Column:
    """Sum of ones; a null condition counts as zero."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), 1)


def minutes_at_quota(rows: Column) -> Column:
    """Ninety rows take ninety seconds."""
    return F.round(rows / F.lit(60.0), 2)
