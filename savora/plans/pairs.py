"""Business name and review as training pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.operators.ranks import keys_at_ranks


def complete_rows(sheet: DataFrame) -> DataFrame:
    """Without the id columns and without rows that miss a value; the rating becomes text."""
    kept = sheet.drop("gmap_id", "user_id").na.drop("any")
    return kept.withColumn("rating", F.col("rating").cast("string"))


def nested_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.struct("business_name").alias("input_text"), F.col("review_text").alias("output_text")
    )


def flat_pairs(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("business_name").alias("input_text"), F.col("review_text").alias("output_text")
    )


def first_rows(rows: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def rows_from(rows: DataFrame, key: str, start: int) -> DataFrame:
    """All rows but the first ``start`` by a unique bigint key.

    A plain OFFSET would pass the whole table through one task; the key at that rank is looked up
    instead and the rest is a filter.
    """
    whole = rows.select(F.lit("all").alias("whole"), key)
    found = keys_at_ranks(whole, "whole", key, ["all"], {"cut": lambda n: min(n, start)})
    return rows.where(F.col(key) > found["all"]["cut"]) if start and found else rows
