"""Counting many terms in one pass over the texts."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COUNTS = pa.schema([("key", pa.string()), ("place", pa.int32()), ("n", pa.int64())])


def _automaton(terms: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        found.add_word(term, (place, len(term)))
    found.make_automaton()
    return found


def occurrences_in(text: str, automaton: ahocorasick.Automaton) -> Iterator[int]:
    """The place of a term for each of its occurrences; those of one term do not overlap, those of different terms may."""
    free: dict[int, int] = {}
    for end, (place, size) in automaton.iter(text):
        if end - size + 1 >= free.get(place, 0):
            free[place] = end + 1
            yield place


def term_totals(rows: DataFrame, key: str, text: Column, terms: Sequence[str]) -> DataFrame:
    """How often each term occurs in all texts of each key, in any case: ``key``, ``term`` and ``n``, 0 where it does not.

    Each text is read once, whatever the number of terms; a task gives out one number per key and term and batch.
    """
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    if not all(wanted):
        raise ValueError("a term must not be empty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(wanted)
        for batch in batches:
            found: dict[str | None, Counter[int]] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = found.setdefault(name, Counter())
                # Every key is there, also one whose texts hold no term.
                counts[0] += 0
                if body:
                    counts.update(occurrences_in(body, automaton))
            flat = [(name, place, n) for name, counts in found.items() for place, n in counts.items()]
            if flat:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*flat), _COUNTS, strict=True)], schema=_COUNTS)

    parts = rows.select(F.col(key).cast("string").alias("key"), F.lower(text).alias("text")).mapInArrow(run, "key string, place int, n bigint")
    sums = parts.groupBy("key", "place").agg(F.sum("n").alias("n"))
    listed = sums.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("held"))
    every = listed.select("key", "held", F.posexplode(F.array(*[F.lit(t) for t in wanted])).alias("place", "low"))
    counted = every.select("key", "low", F.coalesce(F.try_element_at("held", "place"), F.lit(0)).alias("n"))
    named: dict[str, list[str]] = {}
    for term in dict.fromkeys(terms):
        named.setdefault(term.lower(), []).append(term)
    names = F.create_map(*[x for low, own in named.items() for x in (F.lit(low), F.array(*map(F.lit, own)))])
    return counted.select(F.col("key").alias(key), F.explode(F.element_at(names, F.col("low"))).alias("term"), "n")
