"""Token ids in raw payload files with a minimal perfect hash index beside each.

Documents are range-partitioned and sorted by id. Each partition writes one payload file, the ids of its
documents one after the other, two bytes each if the vocabulary allows, else four, and one index file. The
index maps every document key of the shard to a slot of its own: the keys are hashed into a bit array, a
bit is set where exactly one key falls, the other keys go on to the next, smaller array, and the number
of bits set before a key's bit is its slot. A slot holds a fingerprint, the first of the key's entries and
their number; an entry is an offset into the payload. The fingerprint is a mix of all 64 bits that can be
undone, so a key that is not there is never taken for one that is, and the keys need not be stored.

Null texts are empty texts: the end id alone. Documents with a null id come first, are read back with a
null id, and cannot be fetched by key. Repeated ids share a slot; their documents follow each other, by
hash of their text. An empty table gives no documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from savora.llm.common import attempt_name, joined_path, open_folder, record_batches
from savora.llm.tokens import encoder
from savora.session import scratch_path, stored

MAGIC = b"IDSHARD1"
HEADER = struct.Struct("<8sIIQQQ")
GAMMA = 1.5
MOST_LEVELS = 200
MANIFEST = pa.schema(
    [("shard", pa.int64()), ("folder", pa.string()), ("payload", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64()), ("least", pa.int64()), ("most", pa.int64())]
)
MANIFEST_DDL = "shard bigint, folder string, payload string, index string, n_docs bigint, n_ids bigint, n_null bigint, least bigint, most bigint"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
DOCUMENTS_DDL = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_I1, _I2 = (np.uint64(pow(int(m), -1, 1 << 64)) for m in (_M1, _M2))
_S = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix that can be undone: shifts by more than half the width undo themselves."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def unmixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _I2
    x = (x ^ (x >> _S)) * _I1
    return x ^ (x >> _S)


class PerfectHash:
    """Each of n distinct 64-bit keys to a number of its own below n."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [int(bits.sum()) for bits in levels]
        self.first = np.cumsum([0, *ones])
        self.ranks = [np.cumsum(bits, dtype=np.int64) - 1 for bits in levels]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            if len(levels) == MOST_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, int(GAMMA * len(rest)))
            places = cls._places(rest, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[places]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for a key that is not among them."""
        found = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            places = self._places(keys[open_], level, len(bits))
            hit = bits[places]
            found[open_[hit]] = self.first[level] + self.ranks[level][places[hit]]
            open_ = open_[~hit]
        return found


class ShardIndex:
    def __init__(self, width: int, starts: np.ndarray, n_null: int, table: PerfectHash, prints: np.ndarray, entries: np.ndarray, counts: np.ndarray):
        self.width, self.starts, self.n_null = width, starts, n_null
        self.table, self.prints, self.entries, self.counts = table, prints, entries, counts

    @classmethod
    def build(cls, width: int, starts: np.ndarray, n_null: int, keys: np.ndarray) -> ShardIndex:
        """``keys`` ascend, one for each entry behind those without a key."""
        distinct, first, counts = np.unique(keys, return_index=True, return_counts=True)
        hashed = distinct.astype(np.int64).view(np.uint64)
        table = PerfectHash.of(hashed)
        slots = table.slots(hashed)
        prints, entries, numbers = (np.zeros(len(distinct), dtype=t) for t in (np.uint64, np.int64, np.int64))
        prints[slots], entries[slots], numbers[slots] = mixed(hashed), first + n_null, counts
        return cls(width, starts, n_null, table, prints, entries, numbers)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(bits) for bits in self.table.levels], dtype="<u8")
        parts = [
            HEADER.pack(MAGIC, self.width, len(sizes), len(self.starts) - 1, self.n_null, len(self.prints)),
            sizes.tobytes(), self.starts.astype("<u8").tobytes(), self.prints.astype("<u8").tobytes(),
            self.entries.astype("<u8").tobytes(), self.counts.astype("<u8").tobytes(),
        ]
        return b"".join(parts + [np.packbits(bits).tobytes() for bits in self.table.levels])

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        magic, width, n_levels, n_entries, n_null, n_keys = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard index")
        at = HEADER.size

        def numbers(count: int, dtype: str = "<i8") -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=dtype, count=count, offset=at)
            at += 8 * count
            return found

        sizes, starts = numbers(n_levels), numbers(n_entries + 1)
        prints, entries, counts = numbers(n_keys, "<u8"), numbers(n_keys), numbers(n_keys)
        levels = []
        for size in sizes.tolist():
            packed = np.frombuffer(data, dtype=np.uint8, count=(size + 7) // 8, offset=at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(width, starts, n_null, PerfectHash(levels), prints, entries, counts)

    def find(self, keys: np.ndarray) -> list[range]:
        """The entries of each key; none for a key that is not there."""
        hashed = keys.astype(np.int64).view(np.uint64)
        if not len(self.prints):
            return [range(0)] * len(keys)
        slots = self.table.slots(hashed)
        there = (slots >= 0) & (self.prints[slots] == mixed(hashed))
        return [
            range(int(self.entries[s]), int(self.entries[s] + self.counts[s])) if t else range(0)
            for s, t in zip(slots, there, strict=True)
        ]

    def keys(self) -> list[int | None]:
        """The key of every entry, got back from the fingerprints."""
        found = np.zeros(len(self.starts) - 1, dtype=np.int64)
        own = unmixed(self.prints).view(np.int64)
        order = np.argsort(self.entries, kind="stable")
        found[self.n_null:] = np.repeat(own[order], self.counts[order])
        return [None] * self.n_null + found[self.n_null:].tolist()


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str | None = None, text: str = "text") -> DataFrame:
    """Write payloads and indexes of all documents; the manifest, one row per shard, comes back.

    Only the files a successful attempt names are in the manifest.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-shards")
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        width = 2 if max(coder.vocab_size - 1, end_id) < 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        files, root = open_folder(folder)
        name = attempt_name(f"shard-{shard:06d}", "")
        starts, keys, n_null = [0], [], 0
        with files.open_output_stream(joined_path(root, f"{name}.bin")) as out:
            for batch in batches:
                for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.append(coder.encode(body.as_py() or ""), np.uint32(end_id))
                    out.write(ids.astype(f"<u{width}").tobytes())
                    starts.append(starts[-1] + len(ids))
                    if doc_id is None:
                        n_null += 1
                    else:
                        keys.append(doc_id)
        if len(starts) == 1:
            files.delete_file(joined_path(root, f"{name}.bin"))
            return
        index = ShardIndex.build(width, np.array(starts), n_null, np.array(keys, dtype=np.int64))
        with files.open_output_stream(joined_path(root, f"{name}.idx")) as out:
            out.write(index.to_bytes())
        ends = (keys[0], keys[-1]) if keys else (None, None)
        yield from record_batches([(shard, folder, f"{name}.bin", f"{name}.idx", len(starts) - 1, starts[-1], n_null, *ends)], MANIFEST)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    placed = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    written = placed.sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(run, MANIFEST_DDL)
    return stored(written, "token-manifest")


def _opened(folder: str, payload: str, index: str):
    files, root = open_folder(folder)
    with files.open_input_stream(joined_path(root, index)) as f:
        found = ShardIndex.from_bytes(f.read())
    return found, files.open_input_file(joined_path(root, payload))


def _ids(payload, index: ShardIndex, entry: int) -> bytes:
    start, stop = index.starts[entry:entry + 2].tolist()
    raw = payload.read_at((stop - start) * index.width, start * index.width)
    return np.frombuffer(raw, dtype=f"<u{index.width}").astype("<u4").tobytes()


def _read(manifest: DataFrame, keyed: bool) -> DataFrame:
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    wanted = based if keyed else based.where("n_null > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    index, payload = _opened(row["folder"], row["payload"], row["index"])
                    found = [(None, range(index.n_null))]
                    if keyed:
                        keys = np.unique(np.array(index.keys()[index.n_null:], dtype=np.int64))
                        found += zip(keys.tolist(), index.find(keys), strict=True)
                    with payload:
                        for key, entries in found:
                            for entry in entries:
                                ids = _ids(payload, index, entry)
                                yield key, row["base"] + int(index.starts[entry]), len(ids) // 4, ids

        yield from record_batches(rows(), DOCUMENTS)

    # One task per shard: the manifest is small, the files are not.
    spread = wanted.select("folder", "payload", "index", "base").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, DOCUMENTS_DDL)


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of all shards, with the number of ids before it and its ids (little-endian 32-bit).

    Keys are listed from the fingerprints, then each is looked up like any other.
    """
    return _read(manifest, keyed=True)


def read_unkeyed(manifest: DataFrame) -> DataFrame:
    """The documents without an id, which no key finds."""
    return _read(manifest, keyed=False)


def fetch(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents of the wanted keys (column ``doc_id``), through the index; columns as in ``read_documents``.

    The driver holds one row per shard file, as it does for any table's file listing.
    """
    every = manifest.orderBy("shard").collect()
    bases = np.cumsum([0, *[r.n_ids for r in every]]).tolist()
    shards = [(r["folder"], r["payload"], r["index"], base) for r, base in zip(every, bases) if r.least is not None]
    most = np.array([r.most for r in every if r.least is not None], dtype=np.int64)
    least = np.array([r.least for r in every if r.least is not None], dtype=np.int64)

    def reach(ids: pa.Array) -> pa.Array:
        wanted = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        first, last = np.searchsorted(most, wanted, "left"), np.searchsorted(least, wanted, "right")
        return pa.array([list(range(a, b)) for a, b in zip(first, last, strict=True)], pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, index, payload, base = -1, None, None, 0
            for batch in batches:
                shard, wanted = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                for own in np.unique(shard).tolist():
                    if own != now:
                        if payload is not None:
                            payload.close()
                        *names, base = shards[own]
                        now, (index, payload) = own, _opened(*names)
                    part = wanted[shard == own].astype(np.int64)
                    for key, entries in zip(part.tolist(), index.find(part), strict=True):
                        for entry in entries:
                            ids = _ids(payload, index, entry)
                            yield key, base + int(index.starts[entry]), len(ids) // 4, ids
            if payload is not None:
                payload.close()

        yield from record_batches(rows(), DOCUMENTS)

    wanted = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    placed = wanted.select(F.explode(F.arrow_udf(reach, "array<bigint>")("doc_id")).alias("shard"), "doc_id")
    return placed.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(run, DOCUMENTS_DDL)
