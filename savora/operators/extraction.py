"""Meal mentions from review text: a model call per review, or a dictionary join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.response import build_prompt
from savora.operators.answers import AnswerLog, Completer, own_log
from savora.session import stored


def extract_responses(
    reviews: DataFrame, complete: Completer, text: str = "review_text", log: AnswerLog | None = None, **call
) -> DataFrame:
    """``reviews`` plus ``response``, the model's answer to the review's prompt.

    Equal reviews are asked once. With a ``log`` that outlives the run, what it holds is not asked again;
    ``call`` is passed on to ``AnswerLog.ask``.
    """
    return (log or own_log(reviews.sparkSession)).answered(reviews, complete, build_prompt(F.col(text)), **call)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))


def extract_by_dictionary(
    reviews: DataFrame, dictionary: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """Each review with each dictionary meal it mentions; sentiment is the rating scaled to 0..1.

    A meal may have any number of words. Each word of a text first meets the words that meals begin with, alone
    with its place; only there, back in its text, the runs of words are cut that are as long as those meals. So
    what is shuffled does not depend on how long meals are.
    """
    meals = dictionary.select(words_of(F.col("meal_name")).alias("ws")).where(F.size("ws") > 0).distinct()
    meals = stored(meals.select(F.col("ws")[0].alias("word"), F.size("ws").alias("n"), F.array_join("ws", " ").alias("meal_name")), "dictionary")
    # How long the meals are that begin with a word: a few numbers per word.
    starts = stored(meals.groupBy("word").agg(F.collect_set("n").alias("lengths")), "first-words")
    cut = reviews.where(F.col(text).isNotNull()).select(key, "rating", words_of(F.col(text)).alias("words"))
    # Reviews that share a key are told apart by their words.
    cut = cut.withColumn("text__", F.xxhash64("words"))
    placed = cut.select(key, "text__", F.posexplode("words").alias("place", "word")).join(starts, "word")
    begun = placed.groupBy(key, "text__").agg(F.collect_list(F.struct("place", "lengths")).alias("begun"))

    def runs(at: Column) -> Column:
        fitting = F.filter(at["lengths"], lambda n: at["place"] + n <= F.size("words"))
        return F.transform(fitting, lambda n: F.array_join(F.slice("words", at["place"] + 1, n), " "))

    said = cut.join(begun, [key, "text__"]).select(
        key, "rating", F.explode(F.array_distinct(F.flatten(F.transform("begun", runs)))).alias("meal_name")
    )
    # Runs that are no meals are most of them, and go before the rest is shuffled.
    return said.join(meals.select("meal_name"), "meal_name", "left_semi").distinct().select(
        key, "rating", "meal_name", ((F.col("rating") - 1) / F.lit(4.0)).alias("sentiment")
    )
