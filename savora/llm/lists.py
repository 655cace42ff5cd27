"""Comparing the members of many lists pairwise, when single lists may be most of the table.

A list longer than a block is dealt into chunks by the hash of its members, and every pair of chunks is a
block of its own; each pair of members meets in exactly one block. So a task holds two chunks at most,
and a long list spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.session import stored


def blocks(members: DataFrame, key: str, member: str, most: int, name: str, weight: str | None = None, most_weight: int = 1) -> DataFrame:
    """The (key, member) rows of all lists of two or more, with block columns ``i``, ``k`` and their own ``chunk``.

    With a column ``weight`` a chunk also weighs at most about ``most_weight``, or is one member.
    """
    weighed = F.sum(weight) if weight else F.lit(0)
    counts = stored(members.groupBy(key).agg(F.count("*").alias("n__"), weighed.alias("weight__")).where("n__ > 1"), name)
    by_weight = F.least("n__", F.ceil(F.col("weight__") / most_weight))
    chunks = F.greatest(F.ceil(F.col("n__") / most), by_weight).cast("int")
    rows = members.join(counts, key).withColumn("chunk", F.pmod(F.xxhash64(member), chunks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.withColumn("i", F.least("chunk", "other")).withColumn("k", F.greatest("chunk", "other")).drop("n__", "weight__", "other", *([weight] if weight else []))


def compared(rows: DataFrame, key: str, compare: Callable[[pa.RecordBatch, np.ndarray], dict], schema: pa.Schema, ddl: str) -> DataFrame:
    """Run ``compare`` on the blocks of ``rows`` (columns key, i, k, chunk first).

    It gets some whole blocks, one after the other, and where each begins, with the end behind the last;
    it returns the columns of its result. In a block of two chunks (i <> k) only pairs across count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, starts in _whole_blocks(batches):
            found = compare(some, starts)
            size = len(found[schema.names[0]])
            for at in range(0, size, 50_000):
                yield pa.record_batch([pa.array(found[f.name][at:at + 50_000], f.type) for f in schema], schema=schema)

    first = [key, "i", "k", "chunk"]
    rest = [c for c in rows.columns if c not in first]
    placed = rows.select(*first, *rest).repartition(key, "i", "k").sortWithinPartitions(key, "i", "k")
    return placed.mapInArrow(run, ddl)


def sides(block: pa.RecordBatch) -> np.ndarray:
    """Which of a block's two chunks each row is from; all 0 in a block of one."""
    i, k, chunk = (block.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
    return np.where(i == k, 0, np.where(chunk == i, 1, 2))


def may_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows with these sides are a pair of their block."""
    return (a == 0) | (a != b)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by block, some whole blocks at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        table = table.cast(pa.schema([f.with_type(_large(f.type)) for f in table.schema]))
        table = table if rest is None else pa.concat_tables([rest, table])
        starts = _starts(table)
        if len(starts) > 1:
            yield _one_batch(table.slice(0, starts[-1])), starts
        rest = table.slice(starts[-1])
    if rest is not None:
        yield _one_batch(rest), np.array([0, rest.num_rows])


def _large(kind: pa.DataType) -> pa.DataType:
    """The type with 64-bit offsets, at every depth; 32-bit ones end at 2 GiB a column."""
    if pa.types.is_string(kind):
        return pa.large_string()
    if pa.types.is_binary(kind):
        return pa.large_binary()
    if pa.types.is_list(kind):
        return pa.large_list(kind.value_field.with_type(_large(kind.value_type)))
    if pa.types.is_struct(kind):
        return pa.struct([f.with_type(_large(f.type)) for f in kind])
    return kind


def _one_batch(table: pa.Table) -> pa.RecordBatch:
    batches = table.combine_chunks().to_batches()
    if len(batches) != 1:
        raise RuntimeError(f"a block of {table.num_rows} rows came apart into {len(batches)} batches")
    return batches[0]


def _starts(table: pa.Table) -> np.ndarray:
    changed = np.zeros(table.num_rows, dtype=bool)
    changed[0] = True
    for column in range(3):
        values = table.column(column).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


class Forest:
    """Which members hang together, links taken in as they are found."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.top[a] != self.top[b]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.top[a], self.top[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.top, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.top[self.top]
                if (up == self.top).all():
                    break
                self.top = up


def steps(block: np.ndarray, size: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within blocks whose sizes allow the similarity, some at a time.

    Rows are sorted by block and size, so the partners of a row by size are the next ones; all rows step
    on together until none has a partner left.
    """
    a, step = np.arange(len(size) - 1), 1
    while len(a):
        b = a + step
        inside = b < len(size)
        a, b = a[inside], b[inside]
        go_on = (block[a] == block[b]) & (100 * size[a] >= percent * size[b])
        a, b = a[go_on], b[go_on]
        fit = may_pair(side[a], side[b])
        yield a[fit], b[fit]
        step += 1


def local_components(links: tuple[np.ndarray, np.ndarray], order: np.ndarray) -> np.ndarray:
    """For each member the smallest ``order`` it is linked to, directly or over others."""
    at_rank = np.argsort(order, kind="stable")
    label = np.empty(len(order), dtype=np.int64)
    label[at_rank] = np.arange(len(order))
    a, b = links
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        # On to the label of the member that gave the label, so that chains halve.
        label = np.minimum(label, label[at_rank[label]])
        if (label == before).all():
            return order[at_rank[label]]
