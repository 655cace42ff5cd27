"""Flattening of landed place and review payloads.

Each function takes a frame of parsed payload columns (see schemas) and works row by row: nothing is
shuffled, and a payload's arrays never leave their row before they are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_places(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.explode("results").alias("r")).select(
        F.col("r.place_id").alias("rest_id"),
        "r.name",
        "r.rating",
        F.col("r.user_ratings_total").alias("reviews_count"),
        F.col("r.types").alias("type_of_restaurant"),
        "r.business_status",
        F.col("r.formatted_address").alias("address"),
        "r.photos",
    )


def flatten_place_reviews(payloads: DataFrame, *keep: str) -> DataFrame:
    return payloads.select(*keep, F.explode("result.reviews").alias("r")).select(
        *keep, "r.author_name", "r.rating", "r.text"
    )


def flatten_local_results(payloads: DataFrame) -> DataFrame:
    """Twelve optional fields of each hit; payloads that carry an error give none."""
    return payloads.where(F.col("error").isNull()).select(F.explode("local_results").alias("r")).select(
        F.col("r.title").alias("place_name"),
        "r.rating",
        "r.reviews",
        "r.place_id",
        "r.data_id",
        "r.address",
        "r.phone",
        "r.website",
        "r.reviews_link",
        "r.photos_link",
        "r.gps_coordinates",
        "r.thumbnail",
    )


def local_errors(payloads: DataFrame, *keep: str) -> DataFrame:
    return payloads.where(F.col("error").isNotNull()).select(*keep, "error")


def _present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def review_summary(payloads: DataFrame, *keep: str) -> DataFrame:
    """Title, snippets one sentence per line, all recommended dishes, all image links."""
    reviews = F.col("reviews")
    snippets = F.array_join(_present(F.transform(reviews, lambda r: r["snippet"])), " ")
    dishes = _present(F.transform(reviews, lambda r: r["details"]["recommended_dishes"]))
    images = F.flatten(_present(F.transform(reviews, lambda r: r["images"])))
    return payloads.select(
        *keep,
        F.col("place_info.title").alias("title"),
        F.replace(snippets, F.lit(". "), F.lit("\n")).alias("display_text"),
        F.array_join(dishes, "").alias("recommended_dishes"),
        images.alias("image_urls"),
    )


def image_links(payloads: DataFrame, *keep: str) -> DataFrame:
    return payloads.select(
        *keep, F.transform("images_results", lambda x: x["original"]).alias("image_urls")
    )


def place_card(payloads: DataFrame, *keep: str) -> DataFrame:
    """Menu items, review links and the description shown above them."""
    info = F.col("place_info")
    card = F.concat(
        F.lit("Address: "), info["address"],
        F.lit("\nRating: "), info["rating"].cast("string"),
        F.lit("\nReviews: "), info["reviews"].cast("string"),
    )
    return payloads.select(
        *keep,
        info["title"].alias("title"),
        card.alias("description"),
        F.transform("topics", lambda t: t["keyword"]).alias("menu_items"),
        F.transform("reviews", lambda r: r["link"]).alias("links"),
    )


def first_position(payloads: DataFrame, *keep: str) -> DataFrame:
    """Latitude and longitude of the first local hit, null where there is none."""
    gps = F.try_element_at("local_results", F.lit(1))["gps_coordinates"]
    return payloads.select(
        *keep, gps["latitude"].alias("latitude"), gps["longitude"].alias("longitude")
    )
