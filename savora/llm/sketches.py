"""Sketches of which hashes occur twice, partial ones packed small, merged ones one bit a cell.

A partial sketch covers the hashes of one chunk of a table; it lists the cells met once and those met more often, piece by
piece, about a byte or two a cell. Merging adds them up, a piece at a time, and keeps whether a cell was met
twice. The merged sketch lies in the shared folder, and each worker reads it once. Estimates are never too
low: a hash that occurs twice has all its cells met twice.

With ``finer`` bits the hashes are counted in that many times finer cells, and only those met twice get a bit in each row of
the merged sketch. So workers hold bits for what is repeated, not for all that was counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from savora.llm.common import open_folder, record_batches
from savora.session import scratch_path

ROWS = 2
# Bits by which cells are finer while they are counted, if asked for.
FINER = 6
# Cells a sketch row has at least and at most.
LEAST_CELLS, MOST_CELLS = 1 << 22, 1 << 30
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
PARTS = pa.schema([("piece", pa.int32()), ("shift", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
PARTS_DDL = "piece int, shift int, once binary, twice binary"
MERGED = pa.schema([("row", pa.int32()), ("piece", pa.int32()), ("bits", pa.binary())])
MERGED_DDL = "row int, piece int, bits binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def bits_for(hashes: int, most_cells: int = MOST_CELLS) -> int:
    """The cells of a row as a power of two: four to eight for each hash, within the bounds."""
    return max(LEAST_CELLS, min(most_cells, 1 << max(4 * int(hashes), 1).bit_length())).bit_length() - 1


def piece_bits(finer: int) -> int:
    """The counted cells of one piece, as a power of two."""
    return 22 + min(finer, 2)


def _row_cell(counted: np.ndarray, row: int, finer: int) -> np.ndarray:
    """A counted cell's cell in a row of the merged sketch. All its cells lie in the same piece."""
    if row == 0:
        return counted >> np.uint64(finer)
    own = piece_bits(finer) - finer
    return counted >> np.uint64(piece_bits(finer)) << np.uint64(own) | mixed(counted * _ODD) >> np.uint64(64 - own)


def cell_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """With one row the cells are the same whatever ``finer`` was."""
    return hashes >> np.uint64(64 - bits) if row == 0 else _row_cell(hashes >> np.uint64(64 - bits - FINER), row, FINER)


def shift_for(gap: float) -> int:
    """How many low bits are written as they are, so that the gaps of the rest are about 64."""
    return max(0, int(gap).bit_length() - 7)


def packed_cells(cells: np.ndarray, shift: int) -> bytes:
    """Sorted distinct numbers as bytes: the gaps of what is above ``shift`` bits in runs of 255 and a rest, then the low bits."""
    if not len(cells):
        return b""
    high = (cells >> np.uint64(shift)).astype(np.int64)
    gaps = np.diff(high, prepend=0)
    longer = gaps // 255
    out = np.full(int(longer.sum()) + len(gaps), 255, dtype=np.uint8)
    out[np.cumsum(longer + 1) - 1] = gaps % 255
    low = np.packbits((cells[:, None] >> np.arange(shift, dtype=np.uint64) & np.uint64(1)).astype(np.uint8))
    return np.uint32(len(cells)).tobytes() + out.tobytes() + low.tobytes()


def unpacked_cells(data: bytes, shift: int) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    wide = (n * shift + 7) // 8
    gaps = np.frombuffer(data, np.uint8, len(data) - 4 - wide, 4)
    cells = (np.cumsum(gaps, dtype=np.int64)[gaps != 255]) << shift
    if shift:
        low = np.unpackbits(np.frombuffer(data, np.uint8, wide, len(data) - wide), count=n * shift).reshape(n, shift)
        cells |= low.astype(np.int64) @ (1 << np.arange(shift))
    return cells


def of(hashes: np.ndarray, bits: int, finer: int = 0) -> Iterator[tuple]:
    """The partial sketch of a chunk's hashes, each counted as often as it is there, as rows of ``PARTS``."""
    bits, own = bits + finer, piece_bits(finer)
    borders = np.arange(0, (1 << bits) + 1, 1 << own, dtype=np.uint64)
    cells = np.sort(hashes >> np.uint64(64 - bits))
    shift = shift_for((1 << bits) / max(len(cells), 1))
    new = np.ones(len(cells), dtype=bool)
    new[1:] = cells[1:] != cells[:-1]
    once, twice = cells[new], np.unique(cells[~new])
    a, b = np.searchsorted(once, borders), np.searchsorted(twice, borders)
    for piece in np.flatnonzero(np.diff(a)).tolist():
        parts = (x[i[piece]:i[piece + 1]] & np.uint64((1 << own) - 1) for x, i in ((once, a), (twice, b)))
        yield piece, shift, *(packed_cells(p, shift) for p in parts)


def _summed(n_rows: int, finer: int):
    """Sorted sketches of chunks to one bit a cell, piece by piece."""
    counted, cells = 1 << piece_bits(finer), 1 << piece_bits(finer) - finer

    def merged_piece(piece: int, met: np.ndarray) -> Iterator[tuple]:
        twice = np.flatnonzero(met > 1).astype(np.uint64)
        for row in range(n_rows):
            marks = np.zeros(cells, np.uint8)
            marks[_row_cell(twice | np.uint64(piece * counted), row, finer) & np.uint64(cells - 1)] = 1
            yield row, piece, np.packbits(marks, bitorder="little").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, met = None, np.zeros(counted, np.uint8)
        for batch in batches:
            for piece, shift, once, twice in zip(*batch.columns, strict=True):
                if now != piece.as_py():
                    if now is not None:
                        yield from merged_piece(now, met)
                    now = piece.as_py()
                    met[:] = 0
                at = unpacked_cells(once.as_py(), shift.as_py())
                met[at] = np.minimum(met[at] + 1, 2)
                met[unpacked_cells(twice.as_py(), shift.as_py())] = 2
        if now is not None:
            yield from merged_piece(now, met)

    return lambda batches: record_batches(rows(batches), MERGED)


_LOADED: dict[str, list[np.ndarray]] = {}


def load(path: str, bits: int, n_rows: int = ROWS) -> list[np.ndarray]:
    """The merged sketch, read once by each worker from the shared folder."""
    if path not in _LOADED:
        _LOADED.clear()
        sketch = [np.zeros((1 << bits) >> 3, np.uint8) for _ in range(n_rows)]
        files, folder = open_folder(path)
        for info in files.get_file_info(fs.FileSelector(folder)):
            if not info.base_name.startswith("part-"):
                continue
            with files.open_input_file(info.path) as data:
                for batch in pq.ParquetFile(data).iter_batches(batch_size=32):
                    for row, piece, found in zip(*(batch.column(c) for c in ("row", "piece", "bits")), strict=True):
                        own = np.frombuffer(found.as_buffer(), np.uint8)
                        sketch[row.as_py()][piece.as_py() * len(own):(piece.as_py() + 1) * len(own)] = own
        _LOADED[path] = sketch
    return _LOADED[path]


def forget() -> None:
    """Give back what ``load`` holds, so that workers without a task hold nothing."""
    _LOADED.clear()


def merged(parts: DataFrame, n_rows: int = 1, finer: int = 0) -> str:
    """Add up partial sketches; the folder of the merged one comes back."""
    path = scratch_path(parts.sparkSession, "sketch")
    parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(_summed(n_rows, finer), MERGED_DDL).write.parquet(path)
    return path


def repeated(hashes: np.ndarray, bits: int, sketch: list[np.ndarray]) -> np.ndarray:
    """Which hashes may occur twice."""
    found = np.ones(len(hashes), dtype=bool)
    for row, met in enumerate(sketch):
        cell = cell_of(hashes, row, bits)
        found &= (met[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found
