import datetime
import random

import pytest
from pyspark.sql import functions as F

from savora.plans import monitoring, partials
from savora.session import scratch_path
from savora.sources import tables
from savora.streaming import totals
from savora.streaming.feedback import VOTE, append_votes


@pytest.fixture
def store(spark):
    found = tables.TableStore(spark, scratch_path(spark, "store"))
    found.create_empty(["mart.feedback"])
    return found


def land(spark, landing, *votes):
    spark.createDataFrame(list(votes), VOTE).coalesce(1).write.mode("append").json(landing)


def test_votes_are_appended_once(spark, store):
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "checkpoint")
    land(spark, landing, ("Anna's", "taco", 1), ("Anna's", "taco", 0))
    append_votes(store, landing, checkpoint, create_date="2024-01-02").awaitTermination()
    land(spark, landing, ("Anna's", "soup", None))
    append_votes(store, landing, checkpoint, create_date="2024-01-02").awaitTermination()
    append_votes(store, landing, checkpoint).awaitTermination()
    found = store.read("mart.feedback").orderBy("meal_name", "rec_flag").collect()
    assert [(r.meal_name, r.rec_flag, str(r.create_date)) for r in found] == [
        ("soup", None, "2024-01-02"), ("taco", False, "2024-01-02"), ("taco", True, "2024-01-02"),
    ]


def test_two_streams_and_two_starts_keep_every_vote(spark, store):
    for stream in ("web", "app"):
        landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "checkpoint")
        for meal in ("taco", "soup"):
            land(spark, landing, (stream, meal, 1))
            append_votes(store, landing, checkpoint, stream).awaitTermination()
    found = {(r.business_name, r.meal_name) for r in store.read("mart.feedback").collect()}
    assert found == {(s, m) for s in ("web", "app") for m in ("taco", "soup")}
    assert store.read("mart.feedback").where("create_date is null").count() == 0


def test_a_checkpoint_is_required(store):
    with pytest.raises(TypeError):
        append_votes(store, "/nowhere")


def dated_votes(rng, n):
    meals = [f"meal {i}" for i in range(300)]
    return [
        (rng.choice(["Anna's", "Bob's", None]), rng.choice(meals), rng.choice([1, 0, None]), datetime.datetime(2024, 1, rng.randint(1, 9), rng.randint(0, 23)))
        for _ in range(n)
    ]


def test_daily_totals_survive_restarts_and_disorder(spark):
    """Files come in any order of days, the stream stops and starts, one vote is months late."""
    rng = random.Random(3)
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    store.create_empty([totals.TABLE])
    votes = []
    for stream in ("web", "app"):
        landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "checkpoint")
        for _ in range(3):
            part = dated_votes(rng, 200)
            votes += part
            spark.createDataFrame(part, totals.VOTE).repartition(3).write.mode("append").json(landing)
            totals.keep_totals(store, landing, checkpoint, stream, files_per_batch=2).awaitTermination()
    late = [("Cy's", "soup", 1, datetime.datetime(2023, 5, 1))]
    spark.createDataFrame(late, totals.VOTE).coalesce(1).write.mode("append").json(landing)
    totals.keep_totals(store, landing, checkpoint, "app").awaitTermination()
    feedback = spark.createDataFrame(votes + late, totals.VOTE).select(
        "business_name", "meal_name", F.col("feedback").cast("boolean").alias("rec_flag"), F.to_date("voted_at").alias("create_date")
    )
    expected = {r.create_date: r for r in monitoring.feedback_daily(feedback).collect()}
    found = {r.create_date: r for r in totals.daily_totals(store).collect()}
    assert set(found) == set(expected) and len(found) == 10
    for day, row in expected.items():
        for c in (*partials.SUMS, "positive_feedback_perc", "total_restaurants_feedback"):
            assert found[day][c] == row[c], (day, c)
        assert abs(found[day].total_meals_feedback - row.total_meals_feedback) <= 0.05 * row.total_meals_feedback
    # A batch that is tried again replaces itself.
    before = totals.daily_totals(store).orderBy("create_date").collect()
    again = store.read(totals.TABLE).where("stream = 'app' and number = 0")
    store.append(totals.TABLE, spark.createDataFrame(again.collect(), again.schema), "app-0")
    assert totals.daily_totals(store).orderBy("create_date").collect() == before


def test_partials_merge_in_any_order(spark):
    rng = random.Random(4)
    rows = [(f"b{rng.randint(0, 4000)}", f"m{rng.randint(0, 30000)}", rng.random() < 0.7, datetime.date(2024, rng.randint(1, 3), rng.randint(1, 28))) for _ in range(40_000)]
    feedback = spark.createDataFrame(rows, "business_name string, meal_name string, rec_flag boolean, create_date date")
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    store.create_empty([partials.TABLE])
    for n, part in enumerate(feedback.randomSplit([0.2, 0.5, 0.3], 1)):
        partials.add_load(store, part, f"load-{n}")
    stored = store.read(partials.TABLE)
    whole = partials.totals(partials.merged(stored)).first()
    assert partials.totals(partials.merged(partials.by_month(stored))).first() == whole
    assert whole.total_feedback == 40_000 and whole.total_pos_feedback == sum(r[2] for r in rows)
    for name, place in (("total_restaurants_feedback", 0), ("total_meals_feedback", 1)):
        exact = len({r[place] for r in rows})
        assert abs(whole[name] - exact) <= 0.065 * exact
    assert partials.totals(partials.merged(stored.limit(0))).first().total_meals_feedback == 0
    none = spark.createDataFrame([(None, None, None, None)], feedback.schema)
    assert partials.totals(partials.daily_partials(none)).first()[:6] == (None, 0, 0, 1, 0, 0)
