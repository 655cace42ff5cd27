"""From staged reviews of new businesses to labelled meal mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.functions.response import explode_meals, parse_response
from savora.operators.clustering import cluster_mentions
from savora.operators.answers import AnswerLog, Completer
from savora.operators.extraction import extract_by_dictionary, extract_responses
from savora.operators.grouped import first_per_group, modal_value
from savora.operators.stored_clusters import assigned, assigned_names
from savora.plans.staging import new_reviews
from savora.session import stored
from savora.sources.tables import TableStore, meal_mention_rows


def label_clusters(mentions: DataFrame) -> DataFrame:
    """Add ``cluster_label``: the modal meal of the business's cluster."""
    labels = modal_value(mentions, ["business_name", "cluster"], "meal_name", "cluster_label")
    labels = labels.toDF("b__", "c__", "cluster_label")
    return mentions.join(
        labels,
        F.col("business_name").eqNullSafe(F.col("b__")) & F.col("cluster").eqNullSafe(F.col("c__")),
        "left",
    ).drop("b__", "c__")


def sample_labels(mentions: DataFrame, seed: int = 7, most: int = 3) -> DataFrame:
    """Up to three drawn meals per cluster, with replacement, the same on every run.

    Draw i takes the smallest keyed hash among the distinct (meal, copies) of the cluster, raised to
    1/copies, so a meal is drawn in proportion to how often it occurs. Draws are independent.
    """
    counts = mentions.groupBy("cluster", "meal_name").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("cluster").agg(F.sum("n").alias("size")).withColumnRenamed("cluster", "c")
    draws = counts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(most))))
    unit = (F.pmod(F.xxhash64("cluster", "meal_name", "draw", F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(
        float(1 << 52)
    )
    key = -F.ln(unit) / F.col("n")
    picked = draws.groupBy("cluster", "draw").agg(
        F.min(F.struct(key.alias("key"), F.col("meal_name")))["meal_name"].alias("meal_name")
    )
    drawn = picked.join(sizes, F.col("cluster").eqNullSafe(F.col("c"))).where(F.col("draw") <= F.col("size"))
    listed = F.sort_array(F.collect_list(F.struct("draw", "meal_name")))
    return drawn.groupBy("cluster").agg(F.transform(listed, lambda d: d["meal_name"]).alias("cluster_label"))


def with_sample_labels(mentions: DataFrame, seed: int = 7) -> DataFrame:
    """Every mention with the labels drawn for its cluster."""
    labels = sample_labels(mentions, seed).withColumnRenamed("cluster", "c__")
    return mentions.join(labels, F.col("cluster").eqNullSafe(F.col("c__")), "left").drop("c__")


def asked_mentions(reviews: DataFrame, complete: Completer, log: AnswerLog | None = None, **call) -> DataFrame:
    """Mentions from a model's answers; they are logged batch by batch, so nothing is asked twice."""
    asked = extract_responses(reviews.select("business_name", "rating", "review_text"), complete, log=log, **call)
    return explode_meals(parse_response(asked)).select("business_name", "rating", "meal_name", "sentiment")


def known_mentions(reviews: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions of the dictionary's meals, one per meal and review."""
    numbered = stored(
        reviews.select("business_name", "rating", "review_text").withColumn("review__", F.monotonically_increasing_id()), "reviews"
    )
    found = extract_by_dictionary(numbered.select("review__", "rating", "review_text"), dictionary, "review__", "review_text")
    named = numbered.select("review__", "business_name")
    return found.join(named, "review__").select("business_name", "rating", "meal_name", "sentiment")


def meal_mentions(
    reviews: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    percent: int = 50,
    trial_rows: int | None = None,
) -> DataFrame:
    """Extract, cluster and label, for every business in ``reviews``.

    ``extract`` gives (business_name, rating, meal_name, sentiment): ``asked_mentions`` with a model,
    ``known_mentions`` with a dictionary. ``trial_rows`` keeps that many reviews per business; by default
    all are processed.
    """
    if trial_rows:
        reviews = first_per_group(
            reviews, ["business_name"], [F.col("review_text"), F.col("rating")], trial_rows
        ).drop("position")
    mentions = stored(extract(reviews), "mentions")
    clustered = stored(cluster_mentions(mentions, percent), "clusters")
    return meal_mention_rows(label_clusters(clustered))


def process_new(
    store: TableStore, staged: DataFrame, extract: Callable[[DataFrame], DataFrame], batch: str
) -> DataFrame:
    """Mentions of businesses without any are found and appended as one load; the whole table comes back."""
    todo = new_reviews(staged, store.read("mart.meal_mentions"))
    store.append("mart.meal_mentions", meal_mentions(todo, extract), batch)
    return store.read("mart.meal_mentions")


def add_load(store: TableStore, mentions: DataFrame, batch: str, percent: int = 50, **how) -> DataFrame:
    """Append a load's mentions (business_name, rating, meal_name, sentiment), of businesses known or new.

    Names and clusters of earlier loads keep their numbers and labels; see ``stored_clusters``. The clusters that
    the load opened are stored with it. The same load again replaces itself, if no later one was added. The load's rows come back.
    """
    earlier, centres = (store.read_but(t, batch) for t in ("mart.meal_mentions", "mart.meal_centres"))
    names, opened = assigned_names(mentions, earlier, centres, percent, **how)
    store.append("mart.meal_centres", opened, batch)
    return store.append("mart.meal_mentions", meal_mention_rows(assigned(mentions, names)), batch)


def merge_plurals(mentions: DataFrame, per_business: bool = False) -> DataFrame:
    """Labels that are another label plus 's' lose the 's': one pass, over all businesses by default.

    The pairs are found among distinct labels first, so rows meet only the few labels that change.
    """
    scope = ["business_name"] if per_business else []
    labels = mentions.where(F.col("cluster_label").isNotNull()).select(*scope, "cluster_label").distinct()
    singular = labels.select(*scope, F.concat("cluster_label", F.lit("s")).alias("plural__"))
    plurals = labels.withColumnRenamed("cluster_label", "plural__").join(
        singular, [*scope, "plural__"], "left_semi"
    )
    plurals = plurals.withColumn("hit__", F.lit(True))
    if scope:
        plurals = plurals.withColumnRenamed("business_name", "b__")
        same = (F.col("cluster_label") == F.col("plural__")) & (F.col("business_name") == F.col("b__"))
    else:
        same = F.col("cluster_label") == F.col("plural__")
    label = F.col("cluster_label")
    return (
        mentions.join(plurals, same, "left")
        .withColumn(
            "cluster_label",
            F.when(F.col("hit__"), F.substring(label, F.lit(1), F.length(label) - 1)).otherwise(label),
        )
        .drop("plural__", "hit__", "b__")
    )


def mention_totals(mentions: DataFrame) -> DataFrame:
    """Rows, distinct meals with and without null, distinct labels."""
    return mentions.agg(
        F.count("*").alias("records"),
        F.count_distinct("meal_name").alias("meals"),
        (F.count_distinct("meal_name") + F.max(F.col("meal_name").isNull().cast("int"))).alias(
            "meals_with_null"
        ),
        F.count_distinct("cluster_label").alias("labels"),
    )
