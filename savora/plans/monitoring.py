"""Feedback and warehouse usage reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.functions.measures import count_where, percent

# Fixed value: the warehouses watched.
WAREHOUSES = ("COMPUTE_WH", "DBT_WH", "STREAMLIT_WH")

SUMMED = (
    "total_restaurants_feedback", "total_meals_feedback", "total_feedback",
    "total_pos_feedback", "total_neg_feedback",
)


def feedback_daily(feedback: DataFrame) -> DataFrame:
    """Per day: businesses, meals, votes, and the share of positive ones.

    Votes are first counted per day, business and meal, so the distinct counts read few rows.
    """
    per_meal = feedback.groupBy("create_date", "business_name", "meal_name").agg(
        F.count("*").alias("votes"),
        count_where(F.col("rec_flag")).alias("pos"),
        count_where(~F.col("rec_flag")).alias("neg"),
    )
    return (
        per_meal.groupBy("create_date")
        .agg(
            F.count_distinct("business_name").alias("total_restaurants_feedback"),
            F.count_distinct("meal_name").alias("total_meals_feedback"),
            F.sum("votes").alias("total_feedback"),
            F.sum("pos").alias("total_pos_feedback"),
            F.sum("neg").alias("total_neg_feedback"),
        )
        .withColumn(
            "positive_feedback_perc", percent(F.col("total_pos_feedback"), F.col("total_feedback"))
        )
        .orderBy(F.desc("create_date"))
    )


def feedback_total(daily: DataFrame) -> DataFrame:
    """Sums of the daily columns; a business active on two days counts twice."""
    return daily.agg(*[F.sum(c).alias(c) for c in SUMMED]).withColumn(
        "positive_feedback_perc", percent(F.col("total_pos_feedback"), F.col("total_feedback"))
    )


def feedback_overall(feedback: DataFrame) -> DataFrame:
    """The same totals with distinct counts over all days."""
    return feedback_total(feedback_daily(feedback.withColumn("create_date", F.lit(None).cast("date"))))


def _watched(metering: DataFrame, warehouses: Sequence[str]) -> DataFrame:
    return metering.where(F.col("warehouse_name").isin(list(warehouses)))


def usage_total(metering: DataFrame, warehouses: Sequence[str] = WAREHOUSES, top: int = 10) -> DataFrame:
    return (
        _watched(metering, warehouses)
        .groupBy("warehouse_name")
        .agg(F.sum("credits_used").alias("total_credits_used"))
        .orderBy(F.desc("total_credits_used"), "warehouse_name")
        .limit(top)
    )


def usage_month(billing: DataFrame) -> DataFrame:
    month = F.date_trunc("month", "usage_date").cast("date")
    return billing.groupBy(month.alias("usage_month")).agg(F.sum("credits_billed").alias("credits_billed"))


def usage_daily(metering: DataFrame, warehouses: Sequence[str] = WAREHOUSES) -> DataFrame:
    return (
        _watched(metering, warehouses)
        .groupBy(F.col("start_time").cast("date").alias("usage_date"), "warehouse_name")
        .agg(F.sum("credits_used").alias("total_credits_used"))
        .orderBy("warehouse_name", "usage_date")
    )
