"""Removal of passages that already stand in a document with a smaller id, found by windows of words.

A window is some consecutive words of one document. A word goes if a window over it also starts in a document with a smaller
id; windows are judged on the input. Two passes over the texts find them:

* The first counts windows in sketches, one a chunk of documents and range of cells, each document once. A
  sketch of a chunk is the sorted list of its cells, about two bytes for each window; merging sums them and leaves bits
  only for those met twice. Estimates are never too low, so no repeated window is lost.
* The second groups exactly the windows estimated repeated, by a 128-bit digest of their words. Within a chunk all
  but the smallest id of a window are settled at once; only that one meets the other chunks, so a passage that a
  third of all documents share sends one row a chunk and window. Other windows are dropped as soon as they are met, block
  by block, so a chunk holds 24 bytes for each window that may be repeated and nothing else.

The cells grow with the bytes of the table, up to ``most_cells`` a row, which bounds what a worker holds (``sketches.ROWS`` x
``most_cells`` / 8 bytes, and only during a task). Beyond that the estimates get looser and more windows reach the exact grouping, where
they are sorted out; the result is the same.

Words are `[^\\x20\\x09-\\x0D]+`, as they are. Null and empty texts have no words. Documents without an id keep all words and
take none from others. Rows that repeat an id are not smaller than each other; each is judged by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from savora.llm import sketches
from savora.llm.common import flagged, record_batches
from savora.session import stored

WIDTH = 13
# Windows held of a chunk of documents, and bytes of text whose words are looked at together.
CHUNK_WINDOWS, BLOCK_BYTES = 1 << 19, 1 << 18
# Rows of ``FOUND`` given out at a time.
FOUND_ROWS = 20_000
# Bytes up to which words are coded all at once.
LONG_WORD = 256

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
FOUND = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "doc_id", "tag", "start", "n")])
FOUND_DDL = "k1 bigint, k2 bigint, doc_id bigint, tag bigint, start bigint, n bigint"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
RESULT_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"
DIGESTS = pa.schema([*list(RESULT)[:3], ("kept_sha256", pa.string())])
DIGESTS_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def word_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``data`` begins, and two 64-bit codes for each."""
    raw = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], ~_BLANK[raw], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    begin, size = edges[::2], edges[1::2] - edges[::2]
    # Eight bytes at every place; what lies behind a word's end is masked.
    loads = np.ndarray((len(data) + 1,), "<u8", data + b"\0" * 8, strides=(1,))
    codes = [size.astype(np.uint64) * odd for odd in _ODD[:2]]
    at = np.flatnonzero(size <= LONG_WORD)
    for step in range(0, LONG_WORD, 8):
        at = at[size[at] > step]
        if not len(at):
            break
        part = loads[begin[at] + step] & _MASKS[np.minimum(size[at] - step, 8)]
        for lane, odd in zip(codes, _ODD[:2], strict=True):
            lane[at] = sketches.mixed((lane[at] ^ part) * odd)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = np.frombuffer(xxhash.xxh3_128_digest(data[begin[i]:begin[i] + size[i]]), np.uint64)
        codes[0][i], codes[1][i] = digest
    return begin, np.stack(codes, axis=1)


class Chunk:
    """The windows of some documents: their two digests, documents and places.

    Without ``exact`` only first digests and documents are held. With a sketch only windows that may be repeated are.
    """

    def __init__(self, width: int, exact: bool = True, bits: int = 0, sketch: list[np.ndarray] | None = None):
        self.width, self.exact, self.bits, self.sketch = width, exact, bits, sketch
        self.ids: list[int] = []
        self.tags: list[int] = []
        self.first: list[np.ndarray] = []
        self.second: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.start: list[np.ndarray] = []
        self.windows = 0

    def add(self, rows: list[tuple[int, int, bytes]]) -> None:
        """Documents with an id, as (id, tag, text)."""
        places, codes = word_codes(b" ".join(text for _, _, text in rows))
        if len(codes) < self.width:
            return
        ends = np.cumsum([len(text) + 1 for _, _, text in rows])
        stop = np.searchsorted(places, ends)
        sizes = np.diff(stop, prepend=0)
        begin = stop - sizes
        n = np.maximum(sizes - self.width + 1, 0)
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[doc] + start
        total = np.full(len(codes) - self.width + 1, self.width, dtype=np.uint64)
        for j in range(self.width):
            total = sketches.mixed(total * _ODD[0] + codes[j:len(codes) - self.width + 1 + j, 0])
        first = total[at]
        if self.sketch is not None:
            kept = np.flatnonzero(sketches.repeated(first, self.bits, self.sketch))
            first, doc, start, at = first[kept], doc[kept], start[kept], at[kept]
        self.first.append(first)
        self.doc.append(doc + np.int32(len(self.ids)))
        if self.exact:
            second = np.full(len(at), self.width, dtype=np.uint64)
            for j in range(self.width):
                second = sketches.mixed(second * _ODD[2] + codes[at + j, 1])
            self.second.append(second)
            self.start.append(start.astype(np.int32))
        self.ids += [i for i, _, _ in rows]
        self.tags += [t for _, t, _ in rows]
        self.windows += len(first)

    def distinct(self) -> np.ndarray:
        """The digests of all windows, a document's repeated windows once."""
        first, doc = np.concatenate(self.first), np.concatenate(self.doc)
        order = np.argsort(first, kind="stable")
        first, doc = first[order], doc[order]
        again = np.zeros(len(first), dtype=bool)
        again[1:] = (first[1:] == first[:-1]) & (doc[1:] == doc[:-1])
        return first[~again]

    def repeated(self, bits: int = 0, sketch: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """Columns of ``FOUND``: the smallest id of each window under its key (n is 0), then runs of n windows that must go.

        Both come by document and place, which packs well. A sketch drops windows that were held without one.
        """
        first, second, doc, start = (np.concatenate(x) for x in (self.first, self.second, self.doc, self.start))
        if sketch is not None:
            at = np.flatnonzero(sketches.repeated(first, bits, sketch))
            first, second, doc, start = first[at], second[at], doc[at], start[at]
        ids, tags = np.array(self.ids, dtype=np.int64), np.array(self.tags, dtype=np.int64)
        order = np.lexsort((ids[doc], second, first))
        begins = np.ones(len(order), dtype=bool)
        begins[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
        own = ids[doc[order]]
        gone = np.zeros(len(order), dtype=bool)
        gone[order] = own > own[begins][np.cumsum(begins) - 1]
        del order, begins, own
        at = np.flatnonzero(~gone)
        for i in range(0, len(at), FOUND_ROWS):
            part = at[i:i + FOUND_ROWS]
            own = doc[part]
            yield first[part].view(np.int64), second[part].view(np.int64), ids[own], tags[own], start[part], np.zeros(len(part), np.int64)
        doc, start = doc[gone], start[gone]
        run = np.ones(len(doc), dtype=bool)
        run[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
        begin = np.flatnonzero(run)
        n = np.diff(np.append(begin, len(doc)))
        doc, start = doc[begin], start[begin]
        yield tags[doc], start, ids[doc], tags[doc], start, n


def _chunks(batches: Iterator[pa.RecordBatch], new: Callable[[], Chunk]) -> Iterator[Chunk]:
    """Rows (doc_id, tag, text) in chunks of documents."""
    chunk = new()
    held: list[tuple[int, int, bytes]] = []
    weight = 0
    for batch in batches:
        for doc_id, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
            whole = text.as_py()
            if not whole or doc_id is None:
                continue
            held.append((doc_id, tag, whole))
            weight += len(whole)
            if weight >= BLOCK_BYTES:
                chunk.add(held)
                held, weight = [], 0
                if chunk.windows >= CHUNK_WINDOWS:
                    yield chunk
                    chunk = new()
    if held:
        chunk.add(held)
    if chunk.windows:
        yield chunk


def _sketched(width: int, bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for chunk in _chunks(batches, lambda: Chunk(width, exact=False)):
            yield from sketches.of(chunk.distinct(), bits, sketches.FINER)

    return lambda batches: record_batches(rows(batches), sketches.PARTS)


def _candidates(width: int, bits: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for chunk in _chunks(batches, lambda: Chunk(width, True, bits, sketches.load(path, bits))):
                for columns in chunk.repeated():
                    for at in range(0, len(columns[0]), FOUND_ROWS):
                        yield pa.record_batch([pa.array(c[at:at + FOUND_ROWS], pa.int64()) for c in columns], schema=FOUND)
        finally:
            sketches.forget()

    return run


def _cut(width: int, digest: bool):
    """Rows (doc_id, text, runs) to the counts and what is left of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            runs = batch.column(2)
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True)):
                words = (text.as_py() or b"").split()
                left, found = words, runs[i].values
                if found is not None and len(found):
                    start, n = (found.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + n + width - 1, -1)
                    left = [words[j] for j in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                kept = b" ".join(left)
                yield doc_id, len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest() if digest else kept

    return lambda batches: record_batches(rows(batches), DIGESTS if digest else RESULT)


def sketch_bits(docs: DataFrame, text: str, most_cells: int) -> int:
    """How many cells a sketch row gets, as a power of two: about one for each window of the table."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return sketches.bits_for(size // 32, most_cells)


def repeats(rows: DataFrame, width: int, bits: int) -> DataFrame:
    """Of rows (doc_id, tag, text), the windows that must go as runs: ``doc_id``, ``tag`` and ``runs`` of (start, n)."""
    path = sketches.merged(rows.mapInArrow(_sketched(width, bits), sketches.PARTS_DDL), sketches.ROWS, sketches.FINER)
    found = rows.mapInArrow(_candidates(width, bits, path), FOUND_DDL)
    # Runs are keyed by their document and place, so that they spread; they take no part in the comparison.
    least = F.min(F.when(F.col("n") == 0, F.col("doc_id"))).over(Window.partitionBy("k1", "k2"))
    gone = found.withColumn("least", least).where("n > 0 or doc_id > least")
    run = F.struct("start", F.greatest("n", F.lit(1)).alias("n"))
    return gone.groupBy("doc_id", "tag").agg(F.collect_list(run).alias("runs"))


def deduplicated(docs: DataFrame, width: int = WIDTH, text: str = "text", digest: bool = False, most_cells: int = sketches.MOST_CELLS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the words left joined by blanks (or ``kept_sha256``), of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    marks = stored(repeats(rows, width, sketch_bits(rows, "text", most_cells)), "marks")
    ddl, keys = DIGESTS_DDL if digest else RESULT_DDL, ["doc_id", "tag"]
    tested = flagged(rows, marks.select("doc_id"), "perhaps")
    # Texts without a mark stay where they are.
    marked = tested.where("perhaps").join(marks, keys, "left").select("doc_id", "text", "runs")
    plain = tested.where("not perhaps").select("doc_id", "text", F.lit(None).cast("array<struct<start: bigint, n: bigint>>").alias("runs"))
    return marked.mapInArrow(_cut(width, digest), ddl).union(plain.mapInArrow(_cut(width, digest), ddl))
