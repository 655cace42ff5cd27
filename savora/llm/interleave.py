"""Shards that all match the mixture: proportional stratified interleaving.

Rows of each source are put into a seeded random order. A row's fractional rank is its rank within its
source, shifted by a seeded share of one step, over the size of the source; sorted by it, every
stretch of the whole order holds each source in proportion. The order is cut into shards whose row
counts differ by one at most.

Ranks are exact although no task sees a whole source or the whole table: rows are dealt into buckets
of equal hash range (then of equal fraction), bucket counts give each bucket its first rank, and only
single buckets are sorted. The number of buckets has no influence on the result.

Null sources are a source of their own. Repeated rows are ranked one after the other; rows equal in
id, size and checksum may take each other's place. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savora.llm.common import text_or_empty
from savora.session import stored

BUCKETS = 4096
ROW_OVERHEAD = 16
_HEX = 8


def _hex_number(digest: Column, length: int = _HEX) -> Column:
    return F.conv(F.substring(digest, 1, length), 16, 10).cast("bigint")


def _first_ranks(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket, in the order of buckets within the keys."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("n"))
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")


def _ranked(rows: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Rank from 0 of every row within the keys; ``order`` must follow the buckets."""
    first = _first_ranks(rows, keys, bucket)
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        rows.withColumn("row__", F.row_number().over(within))
        .join(first, [*keys, bucket])
        .withColumn("rank", F.col("first") + F.col("row__") - 1)
        .drop("first", "row__")
    )


def interleaved(
    docs: DataFrame, shards: int, seed: int = 7, text: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``source``, ``shard`` and ``slot`` of every document."""
    spark = docs.sparkSession
    source = F.md5(F.concat(F.lit("s"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    content = text_or_empty(text)
    rows = docs.select(
        "doc_id",
        F.col("source"),
        source.alias("stratum"),
        shuffled.alias("order1"),
        (F.octet_length(content).cast("bigint") + ROW_OVERHEAD).alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    whole = 1 << (4 * _HEX)
    rows = rows.withColumn("bucket", F.floor(_hex_number(F.col("order1")) * buckets / F.lit(whole)))
    order = ["order1", "doc_id", "size", "text_crc32"]
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("stratum_rows"))
    ranked = _ranked(rows, ["stratum"], "bucket", order).join(sizes, "stratum")
    shift = _hex_number(F.md5(F.concat(F.lit(f"{seed}|"), F.col("stratum")))) / F.lit(float(whole))
    fraction = (F.col("rank") + shift) / F.col("stratum_rows")
    placed = stored(
        ranked.withColumn("fraction", fraction).drop("rank", "bucket", "order1", "stratum_rows"), "interleave"
    )
    placed = placed.withColumn("bucket", F.floor(F.col("fraction") * buckets)).withColumn("all", F.lit(0))
    order = ["fraction", "stratum", "doc_id", "size", "text_crc32"]
    total = placed.count()
    position = F.col("rank")
    shard = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        _ranked(placed, ["all"], "bucket", order)
        .withColumn("shard", shard)
        .withColumn("slot", position - start)
        .select("doc_id", "size", "text_crc32", "source", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))
    )
