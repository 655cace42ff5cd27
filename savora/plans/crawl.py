"""Comparison of web-crawl snapshots: freshness, dates in addresses, domains.

Records carry ``snapshot``, a unique bigint ``record_id`` and the analysed columns. The snapshots
compared are listed by name, as they are few and the results have a column or row for each.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.text import day_label, url_authority
from savora.operators.ranks import by_group, doubled_medians, first_n_per_group
from savora.operators.terms import term_totals
from savora.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Domains of a block of cross products, and the whole numbers that floats hold exactly.
_BLOCK, _EXACT = 4096, 2.0**53

# Outlier distance, histogram bins, points of a density curve, domains shown.
MAD_LIMIT = 10
BINS = 100
CURVE_POINTS = 200
TOP_DOMAINS = 25


def sample(records: DataFrame, snapshots: Sequence[str], n: int) -> DataFrame:
    """First ``n`` records of each snapshot by id."""
    return first_n_per_group(records, "snapshot", "record_id", snapshots, n)


def reject_outliers(
    records: DataFrame, column: str, snapshots: Sequence[str], limit: int = MAD_LIMIT
) -> DataFrame:
    """Drop values ``limit`` or more median deviations away from their snapshot's median.

    All arithmetic is on whole numbers: doubled medians, doubled deviations. If the median deviation
    is zero, everything stays.
    """
    known = records.where(F.col(column).isNotNull() & F.col("snapshot").isin(list(snapshots)))
    medians = doubled_medians(known, "snapshot", column, snapshots)
    away = F.abs(F.col(column) * 2 - by_group("snapshot", medians))
    spreads = doubled_medians(known.select("snapshot", away.alias("away")), "snapshot", "away", snapshots)
    spread = by_group("snapshot", spreads)
    return known.where((spread == 0) | (away * 2 < spread * limit))


def truncate_to_shortest(records: DataFrame, snapshots: Sequence[str]) -> DataFrame:
    """Cut every snapshot to the length of the shortest, in id order."""
    listed = records.where(F.col("snapshot").isin(list(snapshots)))
    lengths = [r.n for r in listed.groupBy("snapshot").agg(F.count("*").alias("n")).collect()]
    return first_n_per_group(listed, "snapshot", "record_id", snapshots, min(lengths, default=0))


def freshness(
    records: DataFrame, column: str, snapshots: Sequence[str], n: int | None = None, even: bool = True
) -> DataFrame:
    """Records whose time stamps are compared: sampled if asked, without outliers, equal in number.

    The three columns needed are stored first and the filtered rows after: the table itself is read once,
    and what compares the snapshots reads neither it nor the steps again.
    """
    narrow = records.where(F.col("snapshot").isin(list(snapshots))).select("snapshot", "record_id", column)
    narrow = stored(narrow, "crawl-times")
    taken = sample(narrow, snapshots, n) if n else narrow
    kept = stored(reject_outliers(taken, column, snapshots), "crawl-kept")
    return stored(truncate_to_shortest(kept, snapshots), "crawl-even") if even else kept


def snapshot_stats(records: DataFrame, column: str) -> DataFrame:
    """Least, mean and greatest time per snapshot, with the mean's day label."""
    return records.groupBy("snapshot").agg(
        F.count("*").alias("n"),
        F.min(column).alias("min_value"),
        F.avg(column).alias("mean_value"),
        F.max(column).alias("max_value"),
        day_label(F.min(column)).alias("min_day"),
        day_label(F.avg(column)).alias("mean_day"),
        day_label(F.max(column)).alias("max_day"),
    )


def _bounds(records: DataFrame, column: str) -> tuple[Column, Column]:
    ends = records.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return ends.select("low").scalar(), ends.select("high").scalar()


def histogram(records: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Counts per snapshot in equal bins over the range of all snapshots; empty bins have a row with 0."""
    low, high = _bounds(records, column)
    value = F.col(column)
    place = F.floor(F.try_divide((value - low) * bins, high - low)) + 1
    bucket = F.least(F.coalesce(place, F.lit(1)), F.lit(bins)).cast("int")
    counts = records.groupBy("snapshot", bucket.alias("bin")).agg(F.count("*").alias("n"))
    held = counts.groupBy("snapshot").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    every = held.select("snapshot", "held", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.select("snapshot", "bin", F.coalesce(F.try_element_at("held", "bin"), F.lit(0)).alias("n"))


def density(
    records: DataFrame, column: str, bins: int = BINS, points: int = CURVE_POINTS
) -> DataFrame:
    """Smoothed curve per snapshot from its histogram, scaled to counts per bin.

    Gaussian kernels sit on the bin centers; the width follows Scott's rule on the raw values.
    """
    low, high = _bounds(records, column)
    size = records.groupBy("snapshot").agg(
        F.count("*").alias("total"), F.stddev_samp(column).alias("spread")
    )
    bins_of = histogram(records, column, bins).where("n > 0").join(size, "snapshot")
    step = (high - low) / F.lit(float(bins))
    curve = bins_of.withColumn("center", low + (F.col("bin") - 0.5) * step).withColumn(
        "width", F.col("spread") * F.pow(F.col("total"), F.lit(-0.2))
    )
    grid = curve.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", low + F.col("point") * (high - low) / F.lit(float(points - 1))
    )
    gap = F.try_divide(F.col("x") - F.col("center"), F.col("width"))
    weight = F.col("n") * F.exp(-0.5 * gap * gap)
    scale = step / (F.first("width") * math.sqrt(2 * math.pi))
    return grid.groupBy("snapshot", "point").agg(
        F.first("x").alias("x"), (F.sum(weight) * scale).alias("height")
    )


def term_counts(
    records: DataFrame, column: str, terms: Sequence[str], snapshots: Sequence[str]
) -> DataFrame:
    """Occurrences of each term per snapshot, all terms in one pass however many they are."""
    listed = records.where(F.col("snapshot").isin(list(snapshots)))
    return term_totals(listed, "snapshot", F.col(column), terms)


def term_share(counts: DataFrame) -> DataFrame:
    """Each term's part of its snapshot's mentions."""
    sums = counts.groupBy("snapshot").agg(F.sum("n").alias("all_terms"))
    return counts.join(sums, "snapshot").select(
        "snapshot", "term", F.try_divide(F.col("n").cast("double"), F.col("all_terms")).alias("share")
    )


def domain_counts(records: DataFrame, url: str = "url") -> DataFrame:
    return records.groupBy("snapshot", url_authority(F.col(url)).alias("domain")).agg(
        F.count("*").alias("n")
    )


def domain_matrix(records: DataFrame, snapshots: Sequence[str], url: str = "url") -> DataFrame:
    """One row per domain, one count column per snapshot, 0 where it does not occur. One shuffle."""
    held = [F.count_if(F.col("snapshot") == s).alias(s) for s in snapshots]
    return (
        records.where(F.col("snapshot").isin(list(snapshots)))
        .groupBy(url_authority(F.col(url)).alias("domain"))
        .agg(*held)
    )


def _gram(size: int):
    """Sorted rows (domain, place, n) to sums and cross products (i, j, total); (-1, -1) counts domains, (-1, i) sums a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((size + 1, size + 1))
        rest: tuple[str | None, np.ndarray] | None = None

        def taken(matrix: np.ndarray) -> np.ndarray | None:
            """Add a block; the totals come back when they would no longer be exact."""
            nonlocal totals
            block = np.hstack([matrix, np.ones((len(matrix), 1))])
            more = block.T @ block
            if (totals + more).max() >= _EXACT:
                full, totals = totals, more
                return full
            totals += more
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_numpy(zero_copy_only=False)
            place, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            new = np.r_[True, names[1:] != names[:-1]]
            matrix = np.zeros((int(new.sum()), size))
            np.add.at(matrix, (np.cumsum(new) - 1, place), n)
            if rest is not None:
                if rest[0] == names[0]:
                    matrix[0] += rest[1]
                else:
                    matrix = np.vstack([rest[1], matrix])
            rest = (names[-1], matrix[-1].copy())
            for at in range(0, len(matrix) - 1, _BLOCK):
                full = taken(matrix[at:min(at + _BLOCK, len(matrix) - 1)])
                if full is not None:
                    yield _entries(full)
        if rest is not None:
            full = taken(rest[1][None, :])
            if full is not None:
                yield _entries(full)
            yield _entries(totals)

    return run


def _entries(totals: np.ndarray) -> pa.RecordBatch:
    size = len(totals) - 1
    i, j = np.triu_indices(size + 1)
    left, right = np.where(j == size, -1, i), np.where(j == size, np.where(i == size, -1, i), j)
    columns = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(totals[i, j].astype(np.int64))]
    return pa.record_batch(columns, names=["i", "j", "total"])


def snapshot_correlation(counts: DataFrame, snapshots: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two snapshots over all their domains, in long form.

    ``counts`` holds (snapshot, domain, n), an absent pair counts 0. The domains are dealt once; each task adds up the
    cross products of its domains block by block, so a hundred snapshots cost a matrix product, not thousands of
    aggregates. Sums are whole numbers and exact.
    """
    names = list(dict.fromkeys(snapshots))
    numbered = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
    listed = counts.where(F.col("snapshot").isin(names) & F.col("n").isNotNull())
    placed = listed.select("domain", F.element_at(numbered, F.col("snapshot")).alias("place"), F.col("n").cast("bigint").alias("n"))
    parts = placed.repartition("domain").sortWithinPartitions("domain").mapInArrow(_gram(len(names)), "i int, j int, total bigint")
    sums = stored(parts.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("double").alias("total")), "cross-products")
    size = F.coalesce(sums.where("i = -1 and j = -1").select("total").scalar(), F.lit(0.0))
    column = sums.where("i = -1 and j >= 0").select(F.col("j").alias("k"), F.col("total").alias("s"))
    square = sums.where("i = j and i >= 0").select(F.col("i").alias("q"), F.col("total").alias("ss"))
    spread = column.join(square, F.col("k") == F.col("q")).select("k", "s", (size * F.col("ss") - F.col("s") * F.col("s")).alias("v"))
    pairs = sums.where("i >= 0").join(spread.toDF("i", "s_i", "v_i"), "i").join(spread.toDF("j", "s_j", "v_j"), "j")
    corr = F.try_divide(size * F.col("total") - F.col("s_i") * F.col("s_j"), F.sqrt(F.col("v_i")) * F.sqrt(F.col("v_j")))
    both = pairs.select("i", "j", corr.alias("corr"))
    both = both.union(both.where("i <> j").select(F.col("j"), F.col("i"), "corr"))
    name = F.array(*[F.lit(n) for n in names])
    return both.select(
        F.element_at(name, F.col("i") + 1).alias("snapshot_a"), F.element_at(name, F.col("j") + 1).alias("snapshot_b"), "corr"
    )


def domain_correlation(matrix: DataFrame, snapshots: Sequence[str]) -> DataFrame:
    """The same from the wide table of counts."""
    return snapshot_correlation(matrix.unpivot(["domain"], [f"`{s}`" for s in snapshots], "snapshot", "n"), snapshots)


def top_domains(
    matrix: DataFrame, snapshots: Sequence[str], shown: str | None = None, top: int = TOP_DOMAINS
) -> DataFrame:
    """The domains with most records, ordered by all snapshots in turn; counts of one snapshot."""
    order = [F.desc(f"`{s}`") for s in snapshots]
    first = matrix.orderBy(*order, "domain").limit(top)
    long = first.unpivot(["domain"], [f"`{s}`" for s in snapshots], "snapshot", "samples")
    return long.where(F.col("snapshot") == (shown or snapshots[0]))
