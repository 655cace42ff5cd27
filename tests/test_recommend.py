"""Scores, filters and labels on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from savora.plans import marts, meals, recommend, staging

RECS = (
    "business_name string, meal_name string, total_reviews bigint, avg_review_rating double, "
    "avg_meal_sentiment double, total_pos_feedback bigint, total_neg_feedback bigint"
)


def recs(spark, **votes):
    rows = [
        ("Steak House", "food", 16, 4.0, 0.8),
        ("Steak House", "Meat", 8, 4.5, 0.96875),
        ("Steak House", "buffet", 8, 4.25, 0.9375),
        ("Steak House", "Brazilian", 3, 5.0, 1.0),
        ("Steak House", "drinks", 3, 14 / 3, 2.2 / 3),
        ("Steak House", "drink", 9, 4.0, 0.5),
        ("Steak House", "Seafood", 9, 4.0, 0.5),
        ("Steak House", "Sirloin", 1, 4.0, 1.0),
    ]
    return spark.createDataFrame([r + votes.get(r[1], (None, None)) for r in rows], RECS)


def by_meal(frame, column="recommendation_score"):
    return {r["meal_name"]: r[column] for r in frame.collect()}


def test_scores_and_filter(spark):
    shown = by_meal(recommend.ranked(recommend.scored(recs(spark))))
    assert shown == {
        "Meat": pytest.approx(66.6875),
        "buffet": pytest.approx(64.875),
        "Brazilian": pytest.approx(51.25),
        "drinks": pytest.approx(46.5833, abs=1e-4),
    }


def test_ranked_is_sorted(spark):
    scores = [r.recommendation_score for r in recommend.ranked(recommend.scored(recs(spark))).collect()]
    assert scores == sorted(scores, reverse=True)


@pytest.mark.parametrize("votes,score", [((2, 0), 80.025), ((6, 0), 100.0), ((0, 11), -6.66875), ((0, 0), 66.6875)])
def test_feedback_moves_the_score(spark, votes, score):
    assert by_meal(recommend.scored(recs(spark, Meat=votes)))["Meat"] == pytest.approx(score)


def test_normalized_measures(spark):
    scaled = recommend.min_max_normalized(recs(spark))
    assert by_meal(scaled, "total_reviews_normalized")["food"] == 1
    assert by_meal(scaled, "total_reviews_normalized")["Sirloin"] == 0
    flat = recommend.min_max_normalized(recs(spark).where("meal_name = 'food'"))
    assert by_meal(flat, "total_reviews_normalized")["food"] is None


def test_zero_maximum_gives_no_score(spark):
    rows = spark.createDataFrame([("b", "x", 3, 0.0, 0.0, None, None)], RECS)
    assert by_meal(recommend.scored(rows))["x"] is None


def test_quotes_in_names(spark):
    rows = spark.createDataFrame([("Anna's", "taco", 3, 4.0, 1.0, None, None)], RECS)
    assert marts.of_business(rows, "Anna's").count() == 1
    votes = spark.createDataFrame(
        [("Anna''s", "taco", True, None), ("Anna's", "taco", False, None)],
        "business_name string, meal_name string, rec_flag boolean, create_date date",
    )
    repaired = marts.feedback_by_meal(votes, repair_quotes=True).collect()
    assert [(r.business_name, r.total_pos_feedback, r.total_neg_feedback) for r in repaired] == [("Anna's", 1, 1)]


def mentions(spark, rows):
    return spark.createDataFrame(
        rows, "business_name string, rating int, meal_name string, sentiment double, cluster int"
    )


def test_label_is_the_smallest_mode(spark):
    rows = mentions(
        spark,
        [("a", 5, m, 1.0, 3) for m in ("Tri tip", "Flank steak", "Garlic beef")]
        + [("a", 5, m, 1.0, 4) for m in ("x", "y", "y", None, None, None)]
        + [(None, 5, "z", 1.0, 4)],
    )
    labels = {(r.business_name, r.cluster): r.cluster_label for r in meals.label_clusters(rows).collect()}
    assert labels == {("a", 3): "Flank steak", ("a", 4): "y", (None, 4): "z"}


def test_plural_merge_is_one_pass(spark):
    rows = mentions(spark, [("a", 5, "m", 1.0, 0)]).select("business_name")
    labels = [("a", "taco"), ("a", "tacos"), ("a", "tacoss"), ("b", "Tacos"), ("b", "soups"), ("c", ""), ("c", None)]
    rows = spark.createDataFrame(labels, "business_name string, cluster_label string")
    merged = sorted(str(r.cluster_label) for r in meals.merge_plurals(rows).collect())
    assert merged == sorted(["taco", "taco", "tacos", "Tacos", "soups", "", "None"])
    across = spark.createDataFrame([("a", "taco"), ("b", "tacos")], "business_name string, cluster_label string")
    assert {r.cluster_label for r in meals.merge_plurals(across).collect()} == {"taco"}
    assert {r.cluster_label for r in meals.merge_plurals(across, True).collect()} == {"taco", "tacos"}


def test_sample_labels_follow_the_counts(spark):
    rows = mentions(spark, [("a", 5, "x", 1.0, c) for c in range(300) for _ in range(9)] + [("a", 5, "y", 1.0, c) for c in range(300)])
    drawn = meals.sample_labels(rows).collect()
    picks = [m for r in drawn for m in r.cluster_label]
    assert len(picks) == 900 and 0.05 < picks.count("y") / 900 < 0.16
    single = meals.sample_labels(mentions(spark, [("a", 5, "x", 1.0, 1)])).collect()
    assert single[0].cluster_label == ["x"]


def test_sentiment_text_is_cleaned(spark):
    rows = spark.createDataFrame(
        [("a", 4, "-0.5x", "m"), ("a", 4, "", "m"), ("a", 4, "0.7", "m")],
        "business_name string, rating int, sentiment string, cluster_label string",
    )
    assert marts.meal_reviews(rows).collect()[0].avg_meal_sentiment == pytest.approx(0.6)
    small = rows.limit(1).withColumn("sentiment", F.lit(-0.0001))
    assert marts.meal_reviews(small).collect()[0].avg_meal_sentiment == pytest.approx(0.0001)


def test_staging(spark):
    business = spark.createDataFrame(
        [("1", "Anna's", "1 Main St, Springfield, MA", ["Thai restaurant"]), ("2", "Shop", "x", ["Restaurant"]),
         ("1", "Anna's", "1 Main St, Springfield, MA", ["Thai restaurant"])],
        "gmap_id string, name string, address string, category array<string>",
    )
    reviews = spark.createDataFrame(
        [("1", "u", 5, "Très GOOD!"), ("1", "u", 5, "Très GOOD!"), ("1", "v", 4, None), ("2", "u", 5, "x")],
        "gmap_id string, user_id string, rating int, text string",
    )
    rows = staging.staging_reviews(business, reviews).collect()
    assert [(r.business_name, r.city, r.review_text) for r in rows] == [("Anna's", " Springfield", "trs good")]
    kept = staging.staging_reviews(business, reviews, unicode_letters=True).collect()
    assert kept[0].review_text == "très good"
    fallback = reviews.withColumn("review_text", F.lit("spare"))
    assert {r.review_text for r in staging.staging_reviews(business, fallback).collect()} == {"trs good", "spare"}


def test_null_names_stay_new(spark):
    staged = spark.createDataFrame([("a",), (None,), ("b",)], "business_name string")
    done = spark.createDataFrame([("a",), (None,)], "business_name string")
    assert [r.business_name for r in staging.new_businesses(staged, done).collect()] == [None, "b"]
