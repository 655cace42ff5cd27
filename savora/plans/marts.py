"""Recommendation mart: meal aggregates, feedback aggregates and their join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.functions.measures import cleaned_number, count_where
from savora.functions.text import undouble_quotes


def processed_businesses(mentions: DataFrame) -> DataFrame:
    return mentions.select("business_name").distinct().orderBy("business_name")


def meal_reviews(mentions: DataFrame, round_sentiment: bool = False) -> DataFrame:
    """Count, mean rating and mean sentiment per business and label; blank labels do not count."""
    sentiment = cleaned_number(mentions, "sentiment")
    if round_sentiment:
        sentiment = F.round(sentiment)
    return (
        mentions.where(F.col("cluster_label") != "")
        .groupBy("business_name", F.col("cluster_label").alias("meal_name"))
        .agg(
            F.count("*").alias("total_reviews"),
            F.avg("rating").alias("avg_review_rating"),
            F.avg(sentiment).alias("avg_meal_sentiment"),
        )
    )


def feedback_by_meal(feedback: DataFrame, repair_quotes: bool = False) -> DataFrame:
    name = F.col("business_name")
    return feedback.groupBy(
        (undouble_quotes(name) if repair_quotes else name).alias("business_name"), "meal_name"
    ).agg(
        count_where(F.col("rec_flag")).alias("total_pos_feedback"),
        count_where(~F.col("rec_flag")).alias("total_neg_feedback"),
    )


def recommendations(mentions: DataFrame, feedback: DataFrame, repair_quotes: bool = False) -> DataFrame:
    """Meal aggregates with their feedback; both sides are grouped by the join keys already."""
    votes = feedback_by_meal(feedback, repair_quotes)
    return meal_reviews(mentions).join(votes, ["business_name", "meal_name"], "left")


def of_business(recs: DataFrame, business_name: str) -> DataFrame:
    """The name is a value, never SQL text; the filter reaches the scan through the aggregate."""
    return recs.where(F.col("business_name") == F.lit(business_name))


def label_rollup(mentions: DataFrame) -> DataFrame:
    """Label, its count, mean sentiment and mean rating, most frequent first."""
    return (
        mentions.where(F.col("cluster_label").isNotNull())
        .groupBy("cluster_label")
        .agg(
            F.count("*").alias("cluster_label_count"),
            F.avg("sentiment").alias("sentiment_avg"),
            F.avg("rating").alias("rating_avg"),
        )
        .orderBy(F.desc("cluster_label_count"), "cluster_label")
    )
