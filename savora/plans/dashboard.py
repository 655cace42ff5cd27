"""Descriptive tables of the review sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.text import CLOUD_STOPWORDS, split_words
from savora.session import stored


def totals(sheet: DataFrame) -> DataFrame:
    """Businesses (a missing name is one) and reviews."""
    return sheet.agg(
        (F.count_distinct("business_name") + F.max(F.col("business_name").isNull().cast("int"))).alias(
            "num_restaurants"
        ),
        F.count("*").alias("num_reviews"),
    )


def _mean_ratings(sheet: DataFrame) -> DataFrame:
    return (
        sheet.where(F.col("business_name").isNotNull())
        .groupBy(F.col("business_name").alias("name"))
        .agg(F.avg("rating").alias("rating"))
    )


def top_rated(sheet: DataFrame, top: int = 25) -> DataFrame:
    return _mean_ratings(sheet).orderBy(F.desc("rating"), "name").limit(top)


def _review_counts(sheet: DataFrame) -> DataFrame:
    return (
        sheet.where(F.col("business_name").isNotNull())
        .groupBy(F.col("business_name").alias("name"))
        .agg(F.count("*").alias("reviews"))
    )


def most_reviewed(sheet: DataFrame, top: int = 25) -> DataFrame:
    return _review_counts(sheet).orderBy(F.desc("reviews"), "name").limit(top)


def _least(order: Column) -> Column:
    """Name with the smallest order value, the first by name among equals."""
    return F.min(F.struct(order.alias("o"), F.col("name")))["name"]


def extremes(sheet: DataFrame, top: int = 25) -> DataFrame:
    """Best and worst of the top table, best and worst of all, and the most reviewed.

    The table's best is the best of all; its worst is only the last that made the table.
    """
    ratings = _mean_ratings(sheet)
    overall = ratings.agg(_least(-F.col("rating")).alias("highest"), _least(F.col("rating")).alias("lowest"))
    busiest = _review_counts(sheet).agg(_least(-F.col("reviews")).alias("name"))
    table = top_rated(sheet, top)
    return table.agg(
        _least(-F.col("rating")).alias("highest_rated"), _least(F.col("rating")).alias("lowest_rated")
    ).select(
        "highest_rated",
        "lowest_rated",
        overall.select("highest").scalar().alias("highest_overall"),
        overall.select("lowest").scalar().alias("lowest_overall"),
        busiest.scalar().alias("most_reviews"),
    )


def user_histogram(sheet: DataFrame) -> DataFrame:
    """How many users wrote how many reviews."""
    per_user = sheet.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("reviews"))
    return per_user.groupBy("reviews").agg(F.count("*").alias("users")).orderBy("reviews")


def map_points(sheet: DataFrame, locations: DataFrame | None = None, top: int = 10) -> DataFrame:
    """Most reviewed businesses with their tooltip, and their place if a location table is given."""
    points = most_reviewed(sheet, top).withColumn(
        "tooltip", F.format_string("%s: %d reviews", "name", "reviews")
    )
    return points.join(locations, "name", "left") if locations is not None else points


def word_counts(
    sheet: DataFrame,
    text: str = "review_text",
    stopwords: Sequence[str] = CLOUD_STOPWORDS,
    top: int = 100,
    merge_plurals: bool = False,
) -> DataFrame:
    """The most frequent words, in lower case and without stop words."""
    words = sheet.select(F.explode_outer(split_words(F.col(text))).alias("word"))
    counts = _counted(words.select(F.lower("word").alias("word")), stopwords)
    if merge_plurals:
        counts = _merged(counts).select(F.col("key").alias("word"), "n")
    return counts.orderBy(F.desc("n"), "word").limit(top)


def _counted(words: DataFrame, stopwords: Sequence[str]) -> DataFrame:
    # Exploding with "outer" keeps Spark from evaluating the word list once more to test it for size.
    return (
        words.where(F.col("word").isNotNull() & ~F.lower("word").isin(list(stopwords)))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def _stem(word: Column) -> Column:
    """The word without its plural 's', null for others; 'ss' is no plural."""
    return F.when(
        word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)
    )


def _base(low: Column) -> Column:
    """What a word and its plural have in common."""
    return F.coalesce(_stem(low), low)


def _merged(counts: DataFrame) -> DataFrame:
    """One row per term over all cases, a plural counting for the singular where that occurs too.

    A base holds at most the word itself and its plural, so one grouping by it tells whether both occur.
    """
    low, n = F.lower("word"), F.col("n")
    plural = _stem(low).isNotNull()
    sums = counts.groupBy(_base(low).alias("base")).agg(
        F.sum(F.when(~plural, n)).alias("own"), F.sum(F.when(plural, n)).alias("plural")
    )
    return sums.select(
        "base",
        F.when(F.col("own").isNull(), F.concat("base", F.lit("s"))).otherwise(F.col("base")).alias("key"),
        (F.coalesce("own", F.lit(0)) + F.coalesce("plural", F.lit(0))).alias("n"),
    )


def _spelled(counts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The most frequent spelling of each chosen key; ``chosen`` is a short list."""
    low, word = F.lower("word"), F.col("word")
    forms = F.array(
        F.struct(low.alias("key"), word.alias("spelling")),
        F.struct(_stem(low).alias("key"), F.substring(word, F.lit(1), F.length(word) - 1).alias("spelling")),
    )
    best = F.min(F.struct((-F.col("n")).alias("o"), F.col("spelling")))["spelling"]
    return (
        counts.select(F.col("n"), F.inline(forms))
        .join(F.broadcast(chosen.select("key")), "key", "left_semi")
        .groupBy("key", "spelling")
        .agg(F.sum("n").alias("n"))
        .groupBy("key")
        .agg(best.alias("word"))
    )


def _likelihood(k: Column, n: Column, x: Column) -> Column:
    tiny = F.lit(1e-10)
    return F.ln(F.greatest(x, tiny)) * k + F.ln(F.greatest(1 - x, tiny)) * (n - k)


def _pair_score(both: Column, first: Column, second: Column, words: Column) -> Column:
    """Dunning's likelihood ratio: how much more often two words meet than by chance."""
    chance = second / words
    with_first = both / first
    without_first = F.try_divide(second - both, words - first)
    score = 2 * (
        _likelihood(both, first, with_first)
        + _likelihood(second - both, words - first, without_first)
        - _likelihood(both, first, chance)
        - _likelihood(second - both, words - first, chance)
    )
    return F.when((words > first) & (words > second), score).otherwise(0.0)


def cloud_terms(
    sheet: DataFrame,
    text: str = "review_text",
    stopwords: Sequence[str] = CLOUD_STOPWORDS,
    top: int = 100,
    threshold: float = 30.0,
) -> DataFrame:
    """The terms of the word cloud: words, and word pairs that meet far more often than by chance.

    Cases and plurals of a term count together. Occurrences inside a chosen pair no longer count for
    its words. Pairs are taken within a review. The counts are stored, as several steps read them;
    nothing after them goes back to the text, and spellings are looked up for the shown terms only.
    """
    listed = list(stopwords)
    # A stop word is null from here on; each word is looked up once.
    kept = F.transform(split_words(F.col(text)), lambda w: F.when(~F.lower(w).isin(listed), w))
    cut = sheet.select(kept.alias("words"))
    words = F.col("words")
    alone = F.transform(words, lambda w: F.struct(F.lit(False).alias("pair"), w.alias("word")))
    met = F.zip_with(
        words,
        F.slice(words, F.lit(2), F.size(words)),
        lambda a, b: F.struct(F.lit(True).alias("pair"), F.concat(a, F.lit(" "), b).alias("word")),
    )
    # One pass over the texts. "Outer" keeps Spark from working the list out once more to test its size.
    said = cut.select(F.explode_outer(F.concat(alone, met)).alias("t")).select("t.*").where("word is not null")
    counted = stored(said.groupBy("pair", "word").agg(F.count("*").alias("n")), "words-and-pairs")
    singles, pairs = (counted.where(F.col("pair") == p).drop("pair") for p in (False, True))
    terms = _merged(singles)
    total = singles.agg(F.sum("n").alias("n")).first().n or 0
    parts = F.split(F.col("key"), " ")
    # The counts of a pair's two words come by one lookup of both, grouped by the pair.
    looked_up = (
        _merged(pairs)
        .select("key", F.col("n").alias("both"), F.posexplode(F.array(_base(parts[0]), _base(parts[1]))).alias("place", "base"))
        .join(terms.toDF("base", "term", "c"), "base")
    )

    def of(place: int, name: str) -> Column:
        return F.max(F.when(F.col("place") == place, F.col(name)))

    found = looked_up.groupBy("key", "both").agg(
        of(0, "term").alias("key1"), of(1, "term").alias("key2"), of(0, "c").alias("c1"), of(1, "c").alias("c2")
    )
    score = _pair_score(F.col("both"), F.col("c1"), F.col("c2"), F.lit(total))
    chosen = stored(found.where(score > threshold).select("key", "both", "key1", "key2"), "chosen")
    inside = (
        chosen.select("both", F.explode(F.array("key1", "key2")).alias("key"))
        .groupBy("key")
        .agg(F.sum("both").alias("inside"))
    )
    apart = terms.join(inside, "key", "left").select(
        "key", (F.col("n") - F.coalesce("inside", F.lit(0))).alias("n")
    )
    shown = (
        apart.where(F.col("n") > 0)
        .unionByName(chosen.select("key", F.col("both").alias("n")))
        .orderBy(F.desc("n"), "key")
        .limit(top)
    )
    spelled = _spelled(singles.unionByName(pairs), shown)
    return shown.join(spelled, "key").select("word", "n").orderBy(F.desc("n"), "word")


def null_profile(rows: DataFrame) -> DataFrame:
    """One row per column: does it hold a null? All columns are tested in one pass."""
    flags = rows.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in rows.columns])
    return flags.unpivot([], list(rows.columns), "column_name", "has_null")
