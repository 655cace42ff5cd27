"""Group statistics that hold up when one group is most of the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_group_stats(
    rows: DataFrame, keys: Sequence[str], *stats: Column, source: DataFrame | None = None
) -> DataFrame:
    """Give every row the aggregates of its group, taken over ``source`` (by default the rows).

    A window would sort each group inside one task. Here the aggregate combines map-side and comes
    back by an equi-join that the adaptive planner may broadcast or split; nulls form a group.
    """
    small = (rows if source is None else source).groupBy(*keys).agg(*stats)
    for key in keys:
        small = small.withColumnRenamed(key, f"{key}__g")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__g")) for k in keys])
    return rows.join(small, same, "left").drop(*[f"{k}__g" for k in keys])


def modal_value(rows: DataFrame, keys: Sequence[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """The most frequent value per group; ties go to the smallest, nulls never win.

    Counts per value are taken first, so no task holds all values of a group. Rows that have them already, one a value
    of a group, name them by ``weight``.
    """
    known = rows.where(F.col(value).isNotNull())
    counts = known.withColumn("n", F.col(weight)) if weight else known.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value)))
    return counts.groupBy(*keys).agg(best[value].alias(name))


def first_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group in column ``position``.

    k is a small number of rows to show: Spark cuts every map task to k rows per group before the shuffle,
    so a hot group is no problem. Ranks deep into a group are the work of ``operators/ranks.py``.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return (
        rows.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )
