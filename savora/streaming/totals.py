"""Totals of each day, kept as state while votes arrive.

The state of a day is one row: three counts and two sketches. It is never dropped, as days are few, so a vote counts
for its day however late it comes and in whatever order files land; no watermark decides about it. Each micro-batch
writes the days it changed, whole, under its number; a batch that is tried again replaces itself, and
the reader takes the last state of each day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from savora.plans import partials
from savora.sources.tables import TableStore

VOTE = "business_name string, meal_name string, feedback int, voted_at timestamp"
TABLE = "mart.feedback_states"


def keep_totals(store: TableStore, landing: str, checkpoint: str, stream: str = "votes", files_per_batch: int | None = None) -> StreamingQuery:
    """Read the JSON votes that have landed (feedback 1 or 0, with their time) and bring the totals of their days up to date.

    The checkpoint holds the state; each stream keeps its own, and streams into one store need names of their own.
    """
    reader = store.spark.readStream.schema(VOTE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    votes = reader.json(landing).select(
        "business_name", "meal_name", F.col("feedback").cast("boolean").alias("rec_flag"), F.to_date("voted_at").alias("create_date")
    )

    def load(days: DataFrame, number: int) -> None:
        numbered = days.withColumn("stream", F.lit(stream)).withColumn("number", F.lit(number).cast("bigint"))
        store.append(TABLE, numbered, f"{stream}-{number}")

    return (
        partials.daily_partials(votes)
        .writeStream.outputMode("update")
        .foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def day_partials(store: TableStore) -> DataFrame:
    """The last state of every day, all streams merged; partials like those of a load."""
    states = store.read(TABLE)
    kept = [c for c in states.columns if c not in ("stream", "create_date", "number")]
    last = states.groupBy("stream", "create_date").agg(F.max_by(F.struct(*kept), "number").alias("last"))
    return partials.merged(last.select("create_date", "last.*"), "create_date")


def daily_totals(store: TableStore) -> DataFrame:
    """The daily feedback report from the states, with estimated distinct counts."""
    return partials.totals(day_partials(store))
