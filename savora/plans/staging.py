"""From raw dumps to staged reviews, and what is still to be processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from savora.functions.measures import minutes_at_quota
from savora.functions.text import city_of, clean_text
from savora.operators.grouped import first_per_group


def restaurants(business: DataFrame, keyword: str = "restaurant") -> DataFrame:
    """Businesses whose category holds the keyword, case sensitive."""
    category = F.col("category")
    if isinstance(business.schema["category"].dataType, T.ArrayType):
        fits = F.exists(category, lambda c: F.contains(c, F.lit(keyword)))
    else:
        fits = F.contains(category, F.lit(keyword))
    return business.where(fits).select(
        "gmap_id", F.col("name").alias("business_name"), "address", city_of(F.col("address")).alias("city")
    )


def staging_reviews(
    business: DataFrame,
    reviews: DataFrame,
    keyword: str = "restaurant",
    unicode_letters: bool = False,
) -> DataFrame:
    """Cleaned, distinct reviews of restaurants.

    Both sides are made distinct before the join, which gives the same rows as after it: copies
    collapse map-side, and the join, coming last, may have its hot keys split. Whether the restaurants
    are broadcast is left to Spark, which knows their size.
    """
    text = F.col("text")
    if "review_text" in reviews.columns:
        said = F.when(text.isNotNull(), clean_text(text, unicode_letters)).otherwise(F.col("review_text"))
        kept = reviews.where(text.isNotNull() | F.col("review_text").isNotNull())
    else:
        said = clean_text(text, unicode_letters)
        kept = reviews.where(text.isNotNull())
    places = restaurants(business, keyword).distinct()
    spoken = kept.select("gmap_id", "user_id", "rating", said.alias("review_text")).distinct()
    return spoken.join(places, "gmap_id").select(
        "gmap_id", "business_name", "address", "city", "user_id", "rating", "review_text"
    )


def new_businesses(staged: DataFrame, processed: DataFrame) -> DataFrame:
    """Staged names that were not processed yet; a missing name stays, as with NOT EXISTS."""
    known = processed.select("business_name").distinct()
    return staged.select("business_name").distinct().join(known, "business_name", "left_anti").orderBy(
        "business_name"
    )


def new_reviews(staged: DataFrame, processed: DataFrame) -> DataFrame:
    known = processed.select("business_name").distinct()
    return staged.join(known, "business_name", "left_anti")


def reviews_of(staged: DataFrame, business_name: str) -> DataFrame:
    return staged.where(F.col("business_name") == F.lit(business_name)).select(
        "business_name", "rating", "review_text"
    )


def reviews_preview(staged: DataFrame, shown: int = 10) -> DataFrame:
    """Ten reviews per business as one bullet list, in user and text order."""
    order = [F.col("user_id"), F.col("review_text"), F.col("gmap_id"), F.col("rating")]
    top = first_per_group(
        staged.where(F.col("review_text").isNotNull()), ["business_name"], order, shown
    )
    listed = F.sort_array(F.collect_list(F.struct("position", "review_text")))
    return top.groupBy("business_name").agg(
        F.count("*").alias("shown"),
        F.array_join(
            F.transform(listed, lambda r: F.concat(F.lit("- "), r["review_text"])), "\n"
        ).alias("formatted_reviews"),
    )


def time_estimate(staged: DataFrame, trial_rows: int = 100) -> DataFrame:
    """Minutes of model time per business, in full and for the trial size."""
    return staged.groupBy("business_name").agg(
        F.count("*").alias("reviews"),
        minutes_at_quota(F.count("*")).alias("full_minutes"),
        minutes_at_quota(F.least(F.count("*"), F.lit(trial_rows))).alias("trial_minutes"),
    )


def business_dim(sheet: DataFrame) -> DataFrame:
    return sheet.select("gmap_id", "business_name").dropDuplicates(["gmap_id", "business_name"])


def business_lookup(names: DataFrame, sheet: DataFrame) -> DataFrame:
    """One id per asked name, null where the name is unknown."""
    ids = sheet.groupBy("business_name").agg(F.min("gmap_id").alias("gmap_id"))
    return names.select("business_name").join(ids, "business_name", "left")
