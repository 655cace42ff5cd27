"""Feedback totals that merge: counts with sketches in place of distinct counts.

A load's partials are one row a day, however many votes it has. Rows of any loads, days or streams add up to the
totals of a day, a month or all time without reading the votes again; the sketches stand in for the sets of
businesses and meals, whose sizes do not add up. Their estimates have a standard error of 1.6 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.measures import count_where, percent
from savora.sources.tables import TableStore

# Sketches of 2 ** 12 registers, about 2 kB each.
LG_K = 12
SUMS = ("total_feedback", "total_pos_feedback", "total_neg_feedback")
SETS = ("businesses", "meals")
TABLE = "mart.feedback_partials"


def _measures() -> list[Column]:
    return [
        F.count("*").alias("total_feedback"),
        count_where(F.col("rec_flag")).alias("total_pos_feedback"),
        count_where(~F.col("rec_flag")).alias("total_neg_feedback"),
        F.hll_sketch_agg("business_name", F.lit(LG_K)).alias("businesses"),
        F.hll_sketch_agg("meal_name", F.lit(LG_K)).alias("meals"),
    ]


def daily_partials(feedback: DataFrame) -> DataFrame:
    """One row a day; the same code serves a load and a stream."""
    return feedback.groupBy("create_date").agg(*_measures())


def merged(partials: DataFrame, *by: Column | str) -> DataFrame:
    """Partials of coarser groups, or of everything; they merge on in the same way."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    return partials.groupBy(*by).agg(*sums, *[F.hll_union_agg(c).alias(c) for c in SETS])


def by_month(partials: DataFrame) -> DataFrame:
    return merged(partials, F.trunc("create_date", "month").alias("create_month"))


def totals(partials: DataFrame) -> DataFrame:
    """The columns of the feedback reports, with estimated distinct counts."""
    rest = [c for c in partials.columns if c not in SUMS + SETS]
    return partials.select(
        *rest,
        F.coalesce(F.hll_sketch_estimate("businesses"), F.lit(0)).alias("total_restaurants_feedback"),
        F.coalesce(F.hll_sketch_estimate("meals"), F.lit(0)).alias("total_meals_feedback"),
        *SUMS,
        percent(F.col("total_pos_feedback"), F.col("total_feedback")).alias("positive_feedback_perc"),
    )


def add_load(store: TableStore, feedback: DataFrame, batch: str) -> None:
    """Store a load's partials; the same load again replaces them."""
    store.append(TABLE, daily_partials(feedback), batch)
