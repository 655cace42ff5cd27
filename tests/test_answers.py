"""Answers are asked once, whatever dies in between. The model is a plain function; what it is asked lands in a folder."""

import collections
import os
import uuid

import pytest
from pyspark.sql import functions as F

from savora.operators.answers import AnswerLog
from savora.plans import meals, recommend
from savora.session import scratch_path
from savora.sources.tables import TableStore, dated


def counting(folder, dies_at=None):
    """Answers 'A:<prompt>' and leaves a file for each call; dies once, at its call number ``dies_at``."""
    os.makedirs(folder, exist_ok=True)

    def complete(prompts):
        if dies_at is not None and len(os.listdir(folder)) == dies_at:
            with open(f"{folder}/died", "w"):
                pass
            raise RuntimeError("the connection broke")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(prompts))
        return ["A:" + p for p in prompts]

    return complete


def asked(folder):
    found = collections.Counter()
    for name in os.listdir(folder):
        with open(f"{folder}/{name}") as f:
            found.update(line for line in f.read().split("\n") if line)
    return found


def test_a_broken_run_goes_on_where_it_stopped(spark):
    folder, log = scratch_path(spark, "calls"), AnswerLog(spark, scratch_path(spark, "log"), "model-1")
    prompts = spark.range(1000).select(F.concat(F.lit("p"), F.col("id") % 700).alias("prompt"))
    with pytest.raises(Exception, match="connection broke"):
        log.ask(prompts, counting(folder, dies_at=4), lanes=2, pause=0)
    first = sum(asked(folder).values())
    assert 0 < first < 700 and log.answers().count() == first
    again = AnswerLog(spark, log.folder, "model-1")
    assert again.ask(prompts, counting(folder), lanes=3, pause=0) == 700 - first
    assert asked(folder) == {f"p{i}": 1 for i in range(700)}
    assert again.ask(prompts, counting(folder)) == 0
    found = again.answered(prompts, counting(folder), F.col("prompt"))
    assert found.count() == 1000 and found.where("response = concat('A:', prompt)").count() == 1000


def test_a_second_attempt_of_a_task_asks_only_the_rest(spark):
    """Batches keep their places, so an attempt finds what an earlier one of the same job has written."""
    folder, log = scratch_path(spark, "calls"), AnswerLog(spark, scratch_path(spark, "log"))
    prompts = spark.range(450).select(F.concat(F.lit("p"), "id").alias("prompt"))
    with pytest.raises(Exception, match="connection broke"):
        log.ask(prompts, counting(folder, dies_at=2), lanes=1, pause=0)
    before = os.listdir(log.folder + "/batches")
    # The same job as planned before the failure: nothing of the log is subtracted.
    log.pending = lambda rows, prompt: rows.select(log.key(F.col(prompt)).alias("key"), prompt)
    assert log.ask(prompts, counting(folder), lanes=1, pause=0) == 450 - 180
    assert set(before) < set(os.listdir(log.folder + "/batches")) and set(asked(folder).values()) == {1}


def test_models_and_nulls_are_told_apart(spark):
    folder = scratch_path(spark, "log")
    rows = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "prompt string")
    one, two = AnswerLog(spark, folder, "m1"), AnswerLog(spark, folder, "m2")
    assert one.ask(rows, lambda p: [x + "1" if x == "a" else None for x in p]) == 2
    assert two.ask(rows, lambda p: [x + "2" for x in p]) == 2
    found = one.answered(rows, None, F.col("prompt")).collect()
    assert sorted((r.prompt or "", r.response or "") for r in found) == [("", ""), ("a", "a1"), ("a", "a1"), ("b", "")]
    for log in (one, two):
        log.compact()
    assert one.ask(rows, None) == two.ask(rows, None) == 0 and one.answers().count() == 4
    assert one.pending(rows.limit(0)).count() == 0


def test_batches_and_quota(spark):
    log = AnswerLog(spark, scratch_path(spark, "log"))
    rows = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("prompt"))
    log.ask(rows, lambda p: [str(len(p))] * len(p), lanes=1, pause=0)
    assert {r.response for r in log.answers().select("response").distinct().collect()} == {"90", "10"}
    with pytest.raises(ValueError, match="lanes"):
        log.ask(rows, None, pause=1.0)
    with pytest.raises(Exception, match="answer every prompt once"):
        AnswerLog(spark, scratch_path(spark, "log")).ask(rows, lambda p: p[1:])


def test_mentions_and_dietary_answers_through_the_log(spark):
    folder, log = scratch_path(spark, "calls"), AnswerLog(spark, scratch_path(spark, "log"))
    reviews = spark.createDataFrame([("Anna's", 5, "good taco"), ("Bob's", 1, "good taco"), ("Bob's", 2, None)], "business_name string, rating int, review_text string")

    noted = counting(folder)

    def extract(prompts):
        noted([p.replace("\n", " ") for p in prompts])
        return ['[["taco", 0.9]]' if "taco" in p else "No Meals in Review" for p in prompts]

    for _ in range(2):
        found = meals.asked_mentions(reviews, extract, log).where("meal_name <> ''").collect()
        assert sorted((r.business_name, r.meal_name, r.sentiment) for r in found) == [("Anna's", "taco", 0.9), ("Bob's", "taco", 0.9)]
    assert sum(asked(folder).values()) == 2
    menu = spark.createDataFrame([("Anna's", "taco"), ("Bob's", "taco")], "business_name string, meal_name string")
    store = TableStore(spark, scratch_path(spark, "store"))
    store.create_empty(["mart.dietary_responses"])
    rows = recommend.asked_dietary(menu, lambda p: ["yes: " + x for x in p], ("Is it spicy?",), log)
    store.append("mart.dietary_responses", dated(rows, "2024-05-06"), "load-1")
    found = store.read("mart.dietary_responses").collect()
    assert sorted((r.business_name, r.dietary_response) for r in found) == [(b, "yes: I am eating taco. Is it spicy?") for b in ("Anna's", "Bob's")]
