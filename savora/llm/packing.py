"""Order-preserving packing by dynamic programming.

The documents of a partition, in table order, are one stream of ids, each document with an end id behind
it. The stream is cut into sequences of at most ``size`` ids. A cut between documents is free, one
behind a sentence costs a little, one elsewhere (possible after every ``stride`` ids of a longer sentence)
costs more, every sequence has a small cost, and so has each id of padding. A sequence is padded to
``size`` unless its length is a power of two. The cheapest cuts are found in one pass: the cost of padding
is linear in the start of a sequence, so the best start within reach is the head of a monotone queue;
the few starts at a power of two are looked up beside it.

Streams are worked on in blocks, so memory stays bounded: the last sequence of a block is not yet closed
but opens the next block. Null and empty texts are documents of the end id alone. Repeated rows are
documents of their own. Null ids are kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from savora.llm.common import record_batches
from savora.llm.tokens import encoder, token_bytes

BLOCK_IDS = 1 << 20
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
DDL = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class Costs:
    """In ids of padding."""

    sequence: int = 32
    sentence: int = 3
    inside: int = 12


def cheapest_cuts(points: np.ndarray, costs: np.ndarray, size: int, per_sequence: int) -> list[int]:
    """The cuts, as indexes into ``points``, of the cheapest split of [points[0], points[-1]].

    Points ascend and neighbours are at most ``size`` apart; ``costs`` is the price of a cut at each.
    """
    at, price = points.tolist(), costs.tolist()
    place = {p: i for i, p in enumerate(at)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    best, before = [0] * len(at), [0] * len(at)
    # Starts in reach; best[i] + at[i] ascends, as padding to size costs size - (end - start).
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])
    for j in range(1, len(at)):
        end = at[j]
        while at[queue[0][1]] < end - size:
            queue.popleft()
        key, i = queue[0]
        least = key + size - end
        for power in powers:
            k = place.get(end - power)
            if k is not None and best[k] < least:
                least, i = best[k], k
        best[j], before[j] = least + price[j] + per_sequence, i
        key = best[j] + end
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = before[j]
    return [0, *reversed(cuts)]


def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether a sentence or a line ends with it."""
    coder = encoder(path)
    ends = np.zeros(coder.vocab_size, dtype=bool)
    for token, i in coder.tokenizer.get_vocab(with_added_tokens=False).items():
        body = token_bytes(token)
        ends[i] = body.rstrip(b" \"')").endswith((b".", b"!", b"?")) or b"\n" in body
    return ends


class Packer:
    def __init__(self, path: str, size: int, end_id: int, costs: Costs, stride: int, first_sequence: int):
        self.encode, self.ends = encoder(path).encode, sentence_ends(path)
        self.size, self.end_id, self.costs, self.stride = size, end_id, costs, stride
        self.sequence = first_sequence
        # Documents in hand: id, ids of theirs before this block, all their ids, and those in this block.
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []
        self.held = 0

    def _points(self) -> tuple[np.ndarray, np.ndarray]:
        found, prices, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
        for _, _, _, ids in self.docs:
            stops = np.flatnonzero(self.ends[ids]) + 1
            stops = np.unique(np.append(stops[stops < len(ids)], len(ids)))
            gaps = np.diff(stops, prepend=0)
            price = np.full(len(stops), self.costs.sentence)
            price[-1] = 0
            wide = np.flatnonzero(gaps > self.stride)
            if len(wide):
                more = np.concatenate([np.arange(stops[w] - gaps[w] + self.stride, stops[w], self.stride) for w in wide])
                stops, price = np.append(stops, more), np.append(price, np.full(len(more), self.costs.inside))
                order = np.argsort(stops, kind="stable")
                stops, price = stops[order], price[order]
            found.append(stops + base)
            prices.append(price)
            base += len(ids)
        return np.concatenate(found), np.concatenate(prices)

    def add(self, doc_id: int | None, text: str) -> Iterator[tuple]:
        ids = np.append(self.encode(text), np.array([self.end_id], dtype="<u4"))
        self.docs.append((doc_id, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            yield from self.close(last=False)

    def close(self, last: bool) -> Iterator[tuple]:
        """The pieces of the block's sequences, of all but the last if more documents follow."""
        if not self.docs:
            return
        points, prices = self._points()
        cuts = points[cheapest_cuts(points, prices, self.size, self.costs.sequence)].tolist()
        if not last:
            cuts = cuts[:-1]
        which, base = 0, 0
        for begin, end in zip(cuts, cuts[1:]):
            at = begin
            while at < end:
                doc_id, before, total, ids = self.docs[which]
                stop = min(end, base + len(ids))
                yield doc_id, before + at - base, stop - at, ids[at - base:stop - base].tobytes(), total, self.sequence, at - begin
                at = stop
                if at == base + len(ids):
                    base += len(ids)
                    which += 1
            self.sequence += 1
        rest = []
        for doc_id, before, total, ids in self.docs[which:]:
            gone = max(0, cuts[-1] - base)
            rest.append((doc_id, before + gone, total, ids[gone:]))
            base += len(ids)
        self.docs = rest
        self.held = sum(len(d[3]) for d in rest)


def packed(
    docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, costs: Costs = Costs(), stride: int = 32, text: str = "text"
) -> DataFrame:
    """One row per piece of a document in a sequence, with its ids (little-endian 32-bit).

    Sequences keep the order of the rows within each partition of ``docs``; their ids are unique and
    ascend within a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(path, size, end_id, costs, stride, TaskContext.get().partitionId() << 40)

        def pieces():
            for batch in batches:
                for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                    yield from packer.add(doc_id.as_py(), body.as_py() or "")
            yield from packer.close(last=True)

        yield from record_batches(pieces(), SCHEMA)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", f"`{text}` as text").mapInArrow(run, DDL)
