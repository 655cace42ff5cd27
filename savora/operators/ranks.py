"""Exact order statistics per group without sorting a group, neither in one task nor at all.

A few groups (crawl snapshots, say) may hold all rows, so a window per group would run in as many tasks. For a
rank, a quantile sketch of each group, merged map-side, first names a narrow range of keys that must hold it. One
exact pass then counts what lies below the range and each key within; only the counted keys of the range are
shuffled, a few thousandths of the group. Should a sketch be off, the counts show it, and the range is widened.

What comes back to the driver is a few hundred sketch points per listed group, then one number per group and rank,
which stands as a literal in later filters: no join, and a plan that stays flat when steps follow each other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savora.session import stored


def with_running_count(counts: DataFrame, groups: Sequence[str], order: Sequence[str], n: str) -> DataFrame:
    """``upto``: the sum of ``n`` over the group up to and with each row; (groups, order) is unique.

    The partitions are stored, as their numbers must not change between the two uses.
    """
    ranged = counts.repartitionByRange(*groups, *order)
    placed = stored(ranged.withColumn("range__", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*groups).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy(*groups, "range__")
        .agg(F.sum(n).alias("in_range__"))
        .withColumn("before__", F.coalesce(F.sum("in_range__").over(earlier), F.lit(0)))
        .drop("in_range__")
        .toDF(*[f"{g}__g" for g in groups], "r__g", "before__")
    )
    within = Window.partitionBy(*groups, "range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("range__") == F.col("r__g")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__g"))
    return (
        placed.withColumn("within__", F.sum(n).over(within))
        .join(before, same)
        .withColumn("upto", F.col("before__") + F.col("within__"))
        .select(*counts.columns, "upto")
    )


# Points of a group's quantile sketch, and its accuracy: ranks are off by a part of 1 / ACCURACY at most.
POINTS, ACCURACY = 500, 10_000


def _sketched(rows: DataFrame) -> dict[str, tuple[int, list[int]]]:
    """Of each group (g, v) the number of rows and the keys at evenly spaced ranks."""
    points = F.array(*[F.lit(i / POINTS) for i in range(POINTS + 1)])
    found = rows.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", points, F.lit(ACCURACY)).alias("keys")).collect()
    return {r.g: (r.n, r["keys"]) for r in found}


def _range(n: int, keys: Sequence[int], rank: int, slack: int) -> tuple[int, int] | None:
    """The keys between which the rank must lie; None once that is the whole group."""
    at = rank * POINTS / n
    low, high = int(at) - slack, -int(-at // 1) + slack
    if low <= 0 and high >= POINTS:
        return None
    return keys[max(low, 0)] if low > 0 else _LEAST, keys[high] if high < POINTS else _MOST


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _counted(rows: DataFrame, ranges: Mapping[str, Mapping[str, tuple[int, int]]]) -> DataFrame:
    """For each group and rank (g, name): ``c`` rows with key ``v`` inside its range; null stands for all keys below it."""
    cases = [
        F.when(F.col("g") == group, F.array(*[F.struct(F.lit(name).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, (lo, hi) in of.items()]))
        for group, of in ranges.items()
    ]
    placed = rows.withColumn("rank", F.explode(F.coalesce(*cases))).where(F.col("v") <= F.col("rank.hi"))
    key = F.when(F.col("v") >= F.col("rank.lo"), F.col("v"))
    return placed.groupBy("g", F.col("rank.name").alias("name"), key.alias("v")).agg(F.count("*").alias("c"))


def _found(rows: DataFrame, ranges: Mapping[str, Mapping[str, tuple[int, int]]], at: Mapping[str, Mapping[str, int]]) -> dict[tuple[str, str], int]:
    """The key at each group's ranks, as far as it lies within its range."""
    counts = stored(_counted(rows, ranges), "narrow-counts")
    below = {(r.g, r["name"]): r.c for r in counts.where("v is null").collect()}
    rest = F.coalesce(
        *[
            F.when((F.col("g") == g) & (F.col("name") == name), F.lit(rank - below.get((g, name), 0)).cast("bigint"))
            for g, of in at.items() if g in ranges for name, rank in of.items() if name in ranges[g]
        ]
    )
    running = with_running_count(counts.where("v is not null"), ["g", "name"], ["v"], "c").withColumn("rest", rest)
    hit = running.where((F.col("upto") - F.col("c") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    return {(r.g, r["name"]): r.v for r in hit.select("g", "name", "v").collect()}


def keys_at_ranks(
    rows: DataFrame, group: str, key: str, groups: Sequence[str], ranks: Mapping[str, Callable[[int], int]]
) -> dict[str, dict[str, int]]:
    """For each listed group, the key at every rank; a rank is a function of the group's number of keys.

    ``key`` is a bigint; nulls are passed over. A group without keys is left out. ``rows`` is read twice.
    """
    if not groups:
        return {}
    known = rows.where(F.col(group).isin(list(groups)) & F.col(key).isNotNull())
    known = known.select(F.col(group).alias("g"), F.col(key).cast("bigint").alias("v"))
    sketches = _sketched(known)
    at = {g: {name: rank(n) for name, rank in ranks.items() if 1 <= rank(n) <= n} for g, (n, _) in sketches.items()}
    keys: dict[str, dict[str, int]] = {g: {} for g in sketches}
    open_ = {(g, name) for g, of in at.items() for name in of}
    slack = 1
    while open_:
        ranges: dict[str, dict[str, tuple[int, int]]] = {}
        for g, name in sorted(open_):
            ranges.setdefault(g, {})[name] = _range(*sketches[g], at[g][name], slack) or (_LEAST, _MOST)
        for (g, name), v in _found(known, ranges, at).items():
            keys[g][name] = v
            open_.discard((g, name))
        slack *= 8
    return keys


def by_group(group: str, values: Mapping[str, int]) -> Column:
    """The number of the row's group, null for groups without one."""
    chosen = F.lit(None).cast("bigint")
    for name, value in values.items():
        chosen = F.when(F.col(group) == name, F.lit(value).cast("bigint")).otherwise(chosen)
    return chosen


def doubled_medians(rows: DataFrame, group: str, key: str, groups: Sequence[str]) -> dict[str, int]:
    """Twice the exact median per group, which is whole for whole keys."""
    middle = {"lower": lambda n: (n + 1) // 2, "upper": lambda n: n // 2 + 1}
    found = keys_at_ranks(rows, group, key, groups, middle)
    return {g: at["lower"] + at["upper"] for g, at in found.items()}


def first_n_per_group(rows: DataFrame, group: str, key: str, groups: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each listed group by a unique bigint key."""
    found = keys_at_ranks(rows, group, key, groups, {"cut": lambda size: min(size, n)})
    return rows.where(F.col(key) <= by_group(group, {g: at["cut"] for g, at in found.items() if at}))
