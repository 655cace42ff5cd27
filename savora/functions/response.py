"""Prompt for the extraction model and reading of its answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.literal import is_bad, literal_to_json

# The wording of the task, the no-meal answer and the two sentinels.
PROMPT_HEAD = (
    "\n    Your task is to perform the following actions:\n"
    "    1 - Extract each meal names and it's associated sentiment from the text delimited by triple backticks below. \n"
    "    2 - Use a sentiment scale from 0 to 1, where 0 is the most negative sentiment and 1 is the most positive sentiment.\n"
    "    3 - Output as a list of lists in format [[\"meal names\", sentiment]]\n"
    "    4 - If the text does not contain a meal name, then output exactly \"No Meals in Review\".\n"
    "\n    Text:\n    ```"
)
PROMPT_TAIL = "```\n    "
NO_MEALS = "No Meals in Review"
SENTINEL_NAME = ""
SENTINEL_SENTIMENT = 0.5

def build_prompt(text: Column) -> Column:
    """A missing review reads 'None' in the prompt."""
    return F.concat(F.lit(PROMPT_HEAD), F.coalesce(text, F.lit("None")), F.lit(PROMPT_TAIL))


def parse_response(rows: DataFrame, response: str = "response") -> DataFrame:
    """Add ``status`` (ok, no_meals, bad_format) and ``items``, one text per list element.

    The list is read one level at a time, so a bad element does not void its good neighbours. Both JSON and
    Python notation are read, see ``literal``; nested elements come as JSON with numbers as texts.
    """
    answer = F.col(response)
    silent = F.contains(answer, F.lit(NO_MEALS))
    listed = ~silent & F.trim(answer).rlike(r"^[\[(]")
    return rows.withColumn(
        "items", F.when(listed, F.from_json(literal_to_json(answer), "array<string>"))
    ).withColumn(
        "status",
        F.when(silent, "no_meals").when(F.col("items").isNotNull(), "ok").otherwise("bad_format"),
    )


def explode_meals(parsed: DataFrame) -> DataFrame:
    """One row per element; anything that is no pair becomes the sentinel ('', 0.5)."""
    listed = F.col("item").startswith("[") & ~is_bad(F.col("item"))
    pair = F.when(listed, F.from_json(F.col("item"), "array<string>"))
    good = F.size("pair") == 2
    return (
        parsed.withColumn("item", F.explode_outer("items"))
        .withColumn("pair", pair)
        .withColumn("meal_name", F.when(good, F.col("pair")[0]).otherwise(SENTINEL_NAME))
        .withColumn(
            "sentiment",
            F.when(good, F.col("pair")[1].try_cast("double")).otherwise(F.lit(SENTINEL_SENTIMENT)),
        )
        .drop("items", "item", "pair")
    )
