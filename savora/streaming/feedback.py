"""Votes that keep arriving, appended to the feedback table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from savora.sources.tables import TableStore

VOTE = "business_name string, meal_name string, feedback int"


def append_votes(
    store: TableStore, landing: str, checkpoint: str, stream: str = "votes", create_date: str | None = None
) -> StreamingQuery:
    """Read JSON votes (feedback 1 or 0) as they land and append them with their day.

    Every micro-batch is one load named by the stream and its number: a batch that is tried again
    replaces itself and nothing else. The checkpoint knows which files were read and how batches are
    numbered, so each stream must keep its own, and streams into one store need names of their own. A
    vote's day is the day its file landed, so it is the same whenever the batch runs.
    """
    votes = store.spark.readStream.schema(VOTE).json(landing)
    day = F.lit(create_date).cast("date") if create_date else F.to_date("_metadata.file_modification_time")
    rows = votes.select(
        "business_name", "meal_name", F.col("feedback").cast("boolean").alias("rec_flag"), day.alias("create_date")
    )

    def load(batch: DataFrame, number: int) -> None:
        store.append("mart.feedback", batch, f"{stream}-{number}")

    return (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
