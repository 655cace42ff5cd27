"""One huge JSON document, an array of objects, read by many tasks.

The file is cut into byte ranges anywhere. A first pass counts, for each range, its unescaped quotes and by how much it
opens more brackets than it closes, both if it begins inside a string and if it does not; three numbers a range,
from which the state at the start of each follows. In the second pass each task cuts its range at the commas between
top-level elements and reads on behind its end until its last element is whole. Elements are parsed by Spark.

An element is parsed as a row of the schema, null where it is none. Blanks, an empty array and an empty file are no rows.
A task takes as many ranges as make up its share of the bytes, one after the other.
Compressed files cannot be cut; ``read_json_document`` reads them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 << 20
# Bytes of a task, about; small ranges are not a task each.
TASK_BYTES = 16 << 20
_STATES = pa.schema([("path", pa.string()), ("at", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())])
_OPEN, _CLOSE, _QUOTE, _BACK, _COMMA = (np.frombuffer(c, np.uint8) for c in (b"[{", b"]}", b'"', b"\\", b","))


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def _escaped(file, at: int) -> bool:
    """Whether the byte at a position is escaped: an odd number of backslashes stands before it."""
    count = 0
    while at > count and file.read_at(1, at - count - 1) == b"\\":
        count += 1
    return count % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Which bytes are quotes that begin or end a string."""
    place = np.arange(len(data))
    back = data == _BACK
    # How many backslashes stand right before each byte; one before the first if that is escaped.
    last_other = np.maximum.accumulate(np.where(back, -1, place))
    before = np.empty(len(data), dtype=np.int64)
    before[1:] = place[1:] - 1 - last_other[:-1]
    before[:1] = 0
    before[1:][last_other[:-1] < 0] += int(escaped)
    before[:1] += int(escaped)
    return (data == _QUOTE) & (before % 2 == 0)


def _depths(data: np.ndarray, quotes: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte lies outside strings, and by how much brackets up to and with it are open."""
    outside = (np.cumsum(quotes) + in_string) % 2 == 0
    outside &= ~quotes
    steps = (np.isin(data, _OPEN) & outside).astype(np.int64) - (np.isin(data, _CLOSE) & outside)
    return outside, np.cumsum(steps)


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> list[tuple[str, int, int]]:
    """(path, start, end) of all ranges of a file, or of the files of a folder."""
    files, root = _opened(path)
    info = files.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    kept = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
    return [(prefix + p, at, min(at + range_bytes, size)) for p, size in kept for at in range(0, size, range_bytes)]


def _tasks(spark: SparkSession, ranges: list[tuple[str, int, int]]) -> int:
    """In how many tasks the ranges are read."""
    by_bytes = -(-sum(end - start for _, start, end in ranges) // TASK_BYTES)
    return min(len(ranges), max(by_bytes, spark.sparkContext.defaultParallelism))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            files, name = _opened(path)
            with files.open_input_file(name) as file:
                data = np.frombuffer(file.read_at(end - start, start), np.uint8)
                quotes = _quotes(data, _escaped(file, start))
            deltas = [int(_depths(data, quotes, state)[1][-1]) for state in (False, True)]
            rows.append((path, start, int(quotes.sum()), *deltas))
        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), _STATES, strict=True)], schema=_STATES)


def _elements(range_bytes: int):
    """Rows (path, start, end, in_string, depth) to the elements that begin in each range."""

    def cut(path: str, start: int, end: int, in_string: bool, depth: int) -> Iterator[str]:
        files, name = _opened(path)
        with files.open_input_file(name) as file:
            size, at, rest = file.size(), start, None
            while at < size and (at < end or rest is not None):
                stop = min(size, at + range_bytes) if at >= end else end
                raw = file.read_at(stop - at, at)
                data = np.frombuffer(raw, np.uint8)
                quotes = _quotes(data, _escaped(file, at))
                outside, level = _depths(data, quotes, in_string)
                level = level + depth
                opens = np.isin(data, _OPEN) & outside & (level == 1)
                closes = np.isin(data, _CLOSE) & outside & (level == 0)
                commas = (data == _COMMA) & outside & (level == 1)
                for place in np.flatnonzero(opens | closes | commas).tolist():
                    if rest is not None:
                        yield (rest + raw[begin:place]).decode()
                    rest = None
                    if at >= end or closes[place]:
                        # The next element is the next range's, or there is none.
                        if at >= end:
                            return
                        continue
                    rest, begin = b"", place + 1
                if rest is not None:
                    rest, begin = rest + raw[begin:], 0
                in_string, depth, at = bool((int(quotes.sum()) + in_string) % 2), int(level[-1]), stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, weight = [], 0
                for text in cut(*row):
                    if text.strip():
                        held.append(text)
                        weight += len(text)
                    if weight >= 4 << 20:
                        yield pa.record_batch([pa.array(held, pa.string())], names=["element"])
                        held, weight = [], 0
                if held:
                    yield pa.record_batch([pa.array(held, pa.string())], names=["element"])

    return run


def read_json_array(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of a file, or of all files of a folder, each one JSON array; many tasks a file.

    The driver holds a few numbers for each range, as it does for any file's splits.
    """
    ranges = _ranges(spark, path, range_bytes)
    if not ranges:
        return spark.createDataFrame([], schema)
    tasks = _tasks(spark, ranges)
    frame = spark.createDataFrame(ranges, "path string, start bigint, stop bigint").repartition(tasks)
    states = {(r.path, r.at): r for r in frame.mapInArrow(_measured, "path string, at bigint, quotes bigint, outside bigint, inside bigint").collect()}
    placed, now = [], None
    for name, start, end in ranges:
        if now is None or now[0] != name:
            now = (name, False, 0)
        _, in_string, depth = now
        placed.append((name, start, end, in_string, depth))
        state = states[name, start]
        now = (name, bool((state.quotes + in_string) % 2), depth + (state.inside if in_string else state.outside))
    wanted = spark.createDataFrame(placed, "path string, start bigint, stop bigint, in_string boolean, depth bigint").repartition(tasks)
    elements = wanted.mapInArrow(_elements(range_bytes), "element string")
    return elements.select(F.from_json("element", schema).alias("row")).select("row.*")
