"""Scoring, filtering and ranking of meals per business."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.operators.answers import AnswerLog, Completer, own_log
from savora.operators.grouped import attach_group_stats

# Weights of the score, step per feedback, generic words and questions.
WEIGHT_REVIEWS = 0.6
WEIGHT_RATING = 0.3
WEIGHT_SENTIMENT = 0.1
FEEDBACK_STEP = 0.1
GENERIC_WORDS = (
    "food", "drink", "restaurant", "", "price", "breakfast", "brunch", "lunch", "dinner",
    "delicious", "tasty", "service", "atmosphere", "place",
)
GENERIC_PART = "food"
QUESTIONS = (
    "Does this dish contain gluten?",
    "Are there nuts in this meal?",
    "Is this dish suitable for vegetarians?",
    "Is this dish spicy?",
)

_MEASURES = ("total_reviews", "avg_review_rating", "avg_meal_sentiment")


def min_max_normalized(meals: DataFrame) -> DataFrame:
    """Each measure scaled to 0..1 within its business; null where it does not vary."""
    stats = [f(m).alias(f"{n}__{m}") for m in _MEASURES for n, f in (("lo", F.min), ("hi", F.max))]
    scaled = attach_group_stats(meals, ["business_name"], *stats)
    for m in _MEASURES:
        low, high = F.col(f"lo__{m}"), F.col(f"hi__{m}")
        scaled = scaled.withColumn(f"{m}_normalized", F.try_divide(F.col(m) - low, high - low))
    return scaled.drop(*[f"{n}__{m}" for m in _MEASURES for n in ("lo", "hi")])


def with_base_score(meals: DataFrame) -> DataFrame:
    """Weighted share of the business's best value, times 100.

    The best values come from all meals of the business, before any generic word is filtered out.
    """
    best = [F.max(m).alias(f"top__{m}") for m in _MEASURES]
    topped = attach_group_stats(meals, ["business_name"], *best)

    def share(measure: str) -> Column:
        return F.try_divide(F.col(measure), F.col(f"top__{measure}"))

    score = (
        share("total_reviews") * WEIGHT_REVIEWS
        + share("avg_review_rating") * WEIGHT_RATING
        + share("avg_meal_sentiment") * WEIGHT_SENTIMENT
    ) * 100
    return topped.withColumn("recommendation_score", score).drop(*[f"top__{m}" for m in _MEASURES])


def adjusted_score() -> Column:
    """Ten percent up or down per feedback; capped at 100, no floor, untouched without feedback."""
    score = F.col("recommendation_score")
    factor = 1 + F.col("total_pos_feedback") * FEEDBACK_STEP - F.col("total_neg_feedback") * FEEDBACK_STEP
    return F.when(F.col("total_pos_feedback").isNotNull(), F.least(F.lit(100.0), score * factor)).otherwise(score)


def scored(recs: DataFrame) -> DataFrame:
    """Recommendations with their feedback-adjusted score.

    ``recs`` is read twice, for the best values and for the rows. Pass the stored mart when scoring all
    businesses: over the view, a later filter reaches one of the reads only and both aggregate anew.
    """
    return with_base_score(recs).withColumn("recommendation_score", adjusted_score())


def menu_filter(
    meals: DataFrame,
    words: Sequence[str] = GENERIC_WORDS,
    part: str = GENERIC_PART,
    least_reviews: int = 2,
) -> DataFrame:
    low = F.lower("meal_name")
    return meals.where(
        ~low.isin(list(words)) & (F.col("total_reviews") >= least_reviews) & ~F.contains(low, F.lit(part))
    )


def ranked(scores: DataFrame, **rules) -> DataFrame:
    """The table shown to the user, best first within each business."""
    return (
        menu_filter(scores, **rules)
        .select("business_name", "meal_name", "recommendation_score", *_MEASURES)
        .orderBy("business_name", F.desc("recommendation_score"), "meal_name")
    )


def feedback_menu(meals: DataFrame, **rules) -> DataFrame:
    """Meals a user may rate, by name."""
    return menu_filter(meals, **rules).select("business_name", "meal_name").orderBy(
        "business_name", "meal_name"
    )


def businesses_without_meals(meals: DataFrame, mentions: DataFrame, **rules) -> DataFrame:
    """Processed businesses for which no meal passes the filter."""
    kept = menu_filter(meals, **rules).select("business_name").distinct()
    return mentions.select("business_name").distinct().join(kept, "business_name", "left_anti")


def dietary_prompts(menu: DataFrame, questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """Every meal with every question and the text to ask."""
    asked = F.explode(F.array(*[F.lit(q) for q in questions]))
    return menu.select("business_name", "meal_name", asked.alias("dietary_question")).withColumn(
        "prompt", F.format_string("I am eating %s. %s", "meal_name", "dietary_question")
    )


def asked_dietary(menu: DataFrame, complete: Completer, questions: Sequence[str] = QUESTIONS, log: AnswerLog | None = None, **call) -> DataFrame:
    """Rows for the responses table, with a model's answer to every question about every meal of ``menu``.

    A meal that several businesses serve is asked about once.
    """
    prompts = dietary_prompts(menu, questions)
    answered = (log or own_log(menu.sparkSession)).answered(prompts, complete, F.col("prompt"), **call)
    return dietary_responses(answered)


def dietary_responses(answered: DataFrame) -> DataFrame:
    """Answered prompts as rows for the responses table."""
    return answered.select(
        "business_name", "meal_name", "dietary_question", F.col("response").alias("dietary_response")
    )
