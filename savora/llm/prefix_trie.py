"""The prefix trie of conversations, from padded matrices of turn ids.

A turn is known by the digest of its role and text, a conversation by its path, the digests of its turns in
order. Conversations with equal paths become one row before anything is sorted. Paths are dealt into ranges
and sorted; a range is worked on in slabs of bounded size. Each slab is a padded matrix, some columns at a time: lexsort
orders its rows, the masks of what changes from row to row, OR-accumulated over the columns, mark where nodes begin, and
reduceat sums every depth. Rows that share no further turn leave the matrix; the nodes behind are a plain chain.

A node that reaches over a slab's border lies on the path of the slab's first or last row. These nodes, the
spines, are given out in parts and summed by node; what the nodes of the spines themselves add to their
subtrees goes up along each spine, every node counted on one spine only. All other nodes are final in their slab.

Turns are ordered by number (null first), then role, then digest; a null role or text is empty. Rows without a conversation id
belong to none. Rows that repeat a turn are turns of their own. An empty table has no nodes, not even a root.
Memory: a conversation needs 24 bytes a turn in one row, whatever its texts; slabs hold ``SLAB_BYTES`` or one row.
The conversations that end at a node are hashed in the order of their ids by one task, as a digest of one
string must be, but sorted and written out as text by many.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from savora.llm.common import record_batches, text_or_empty
from savora.session import stored

ID = 16
BAND = 16
# Paths and word counts held at once, and how many turns of a path deal it into a range.
SLAB_BYTES = 48 << 20
RANGE_TURNS = 32
PIECE_IDS = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()

PATHS = pa.schema([("conv_id", pa.int64()), ("key", pa.binary()), ("path", pa.binary()), ("words", pa.binary())])
PATHS_DDL = "conv_id bigint, key binary, path binary, words binary"
PIECES = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
PIECES_DDL = "key binary, first bigint, n bigint, ids string"
ENDS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
ENDS_DDL = "key binary, n bigint, least bigint, ends string"
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NODES = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in _COUNTS]
    + [("ends", pa.string()), ("parent", pa.binary()), ("slab", pa.int64()), ("side", pa.int32()), ("node", pa.binary()), ("words", pa.int64())]
)
NODES_DDL = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends string, parent binary, slab bigint, side int, node binary, words bigint"
)


def _rebuild(heads: int, family: int):
    """Sorted rows (base, conv_id, digest, words), a family's base first, to whole rebuilt conversations."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
        held: tuple[int, int] | None = None
        paths: list[bytes] = []
        words: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            base, conv, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3))
            data = batch.column(2).cast(pa.large_binary())
            flat = b"".join(data.to_pylist())
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(conv)]):
                now = (int(base[a]), int(conv[a]))
                if held is not None and held != now:
                    yield *held, b"".join(paths), np.concatenate(words)
                    paths, words = [], []
                held = now
                paths.append(flat[a * ID:b * ID])
                words.append(n[a:b])
        if held is not None:
            yield *held, b"".join(paths), np.concatenate(words)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        family_now, head, head_words = None, b"", np.zeros(0, np.int64)
        for base, conv, path, words in whole(batches):
            if base != family_now:
                family_now, head, head_words = base, b"", np.zeros(0, np.int64)
            if conv == base:
                head, head_words = path[:heads * ID], words[:heads]
            borrowed = zlib.crc32(str(conv).encode()) % (heads + 1)
            path = head[:borrowed * ID] + path[borrowed * ID:]
            words = np.concatenate([head_words[:borrowed], words[borrowed:]])
            yield conv, hashlib.md5(path).digest(), path, words.astype("<i8").tobytes()

    return lambda batches: record_batches(rows(batches), PATHS)


def rebuilt(conversations: DataFrame, family: int = 20, heads: int = 3) -> DataFrame:
    """``conv_id``, ``key``, ``path`` and ``words`` of every conversation, begun with turns of its family's base.

    The base of c is c - c % ``family``; the first crc32(c) % (``heads`` + 1) turns are the base's. A base
    that is no conversation has none to give.
    """
    role, text, conv = text_or_empty("role"), text_or_empty("text"), F.col("conv_id").cast("bigint")
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % family).alias("base"),
        conv.alias("conv"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
    )
    order = ["base", F.col("conv") != F.col("base"), "conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    placed = turns.repartition("base").sortWithinPartitions(*order).select("base", "conv", "digest", "words")
    return placed.mapInArrow(_rebuild(heads, family), PATHS_DDL)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id) to the ids of each key as text, some at a time."""

    def rows() -> Iterator[tuple]:
        key, ids = None, []
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) == PIECE_IDS):
                    yield key, ids[0], len(ids), ",".join(map(str, ids))
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield key, ids[0], len(ids), ",".join(map(str, ids))

    return record_batches(rows(), PIECES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row a key, with the digest of all its ids."""

    def rows() -> Iterator[tuple]:
        key = digest = None
        n = least = 0
        for batch in batches:
            for k, first, more, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is not None and k == key:
                    digest.update(b",")
                    n += more
                else:
                    if digest is not None:
                        yield key, n, least, digest.hexdigest()
                    key, n, least, digest = k, more, first, hashlib.sha256()
                digest.update(ids.encode())
        if digest is not None:
            yield key, n, least, digest.hexdigest()

    return record_batches(rows(), ENDS)


def ends_of(paths: DataFrame) -> DataFrame:
    """For every distinct path its ``key``, how many conversations it is, the smallest and the digest of all."""
    ids = paths.select("key", "conv_id")
    pieces = ids.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, PIECES_DDL)
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, ENDS_DDL)


def _matrix(paths: list[bytes], first: int) -> np.ndarray:
    """Ids of the turns from ``first`` on, a pair of numbers each, padded with zeros."""
    parts = [p[first * ID:(first + BAND) * ID].ljust(BAND * ID, b"\0") for p in paths]
    return np.frombuffer(b"".join(parts), dtype=">u8").astype(np.uint64).reshape(len(paths), BAND, 2)


def _level(paths: list[bytes], size: np.ndarray, alive: np.ndarray, group: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alive rows in the order of their next turns, their groups, and for each column where a new node begins."""
    matrix = _matrix([paths[i] for i in alive.tolist()], first)
    columns = [matrix[:, j, half] for j in reversed(range(BAND)) for half in (1, 0)]
    order = np.lexsort([np.minimum(size[alive], first + BAND), *columns, group])
    alive, group, matrix = alive[order], group[order], matrix[order]
    there = size[alive][:, None] > first + np.arange(BAND)
    changed = np.ones((len(alive), BAND), dtype=bool)
    changed[1:] = (matrix[1:] != matrix[:-1]).any(axis=2) | (there[1:] != there[:-1])
    changed[1:, 0] |= group[1:] != group[:-1]
    return alive, group, np.logical_or.accumulate(changed, axis=1)


class Slab:
    """The trie of some distinct paths in ascending order; see ``rows`` for what it gives out."""

    def __init__(self, paths: list[bytes], words: list[np.ndarray], n: np.ndarray, least: np.ndarray, ends: list[str]):
        self.paths, self.words, self.n, self.least, self.ends = paths, words, n, least, ends
        self.size = np.array([len(p) // ID for p in paths], dtype=np.int64)
        self._grow()

    def _grow(self) -> None:
        size, n, least, last = self.size, self.n, self.least, len(self.paths) - 1
        empty = np.zeros(0, np.int64)
        # One entry a depth; parents are places in all nodes, in the order of depth.
        parent, convs, conv, own_words, end = [np.array([-1])], [np.array([n.sum()])], [np.array([least.min()])], [np.array([0])], [np.array([-1])]
        ended = np.flatnonzero(size == 0)
        if len(ended):
            end[0][0] = ended[0]
        sides: list[list[int]] = [[0], [0]]  # the nodes of the first and the last row
        tails: list[tuple[np.ndarray, np.ndarray, int]] = []
        alive, group, first, known = np.arange(last + 1)[size > 0], np.zeros(int((size > 0).sum()), np.int64), 0, 1
        while len(alive):
            alive, group, changed = _level(self.paths, size, alive, group, first)
            for j in range(BAND):
                live = np.flatnonzero(size[alive] > first + j)
                if not len(live):
                    break
                starts = np.flatnonzero(changed[live, j])
                rows = alive[live]
                place = known + np.cumsum(changed[live, j]) - 1
                parent.append(group[live][starts])
                convs.append(np.add.reduceat(n[rows], starts))
                conv.append(np.minimum.reduceat(least[rows], starts))
                own_words.append(np.array([self.words[r][first + j] for r in rows[starts].tolist()], dtype=np.int64))
                stop = np.full(len(starts), -1)
                done = size[rows] == first + j + 1
                stop[place[done] - known] = rows[done]
                end.append(stop)
                for side, row in ((0, 0), (1, last)):
                    found = np.flatnonzero(rows == row)
                    if len(found):
                        sides[side].append(int(place[found[0]]))
                group[live] = place
                known += len(starts)
            first += BAND
            further = size[alive] > first
            alive, group = alive[further], group[further]
            _, at, times = np.unique(group, return_inverse=True, return_counts=True)
            single = times[at] == 1 if len(group) else np.zeros(0, bool)
            tails.append((alive[single], group[single], first))
            alive, group = alive[~single], group[~single]
        self.levels = [len(p) for p in parent]
        self.parent, self.convs, self.conv, self.own_words, self.end = (np.concatenate(x) for x in (parent, convs, conv, own_words, end))
        self.sides = sides
        self.tails = [np.concatenate([empty, *(t[0] for t in tails)]), np.concatenate([empty, *(t[1] for t in tails)]), np.concatenate([empty, *(np.full(len(t[0]), t[2]) for t in tails)])]

    def _chains(self, spine_rows: set[int]):
        """The chains behind the matrix as columns, with what each adds to the node it hangs on."""
        rows, hung, first = self.tails
        spine = np.isin(rows, list(spine_rows))
        rest = self.size[rows] - first
        of = np.repeat(np.arange(len(rows)), rest)
        begin = np.cumsum(rest) - rest
        depth = np.arange(len(of)) - np.repeat(begin, rest) + first[of] + 1
        counts = [self.words[r][f:] for r, f in zip(rows.tolist(), first.tolist())]
        words = np.concatenate([np.zeros(0, np.int64), *counts])
        saved = words * (self.n[rows][of] - 1)
        total = np.add.reduceat(saved, begin) if len(rows) else np.zeros(0, np.int64)
        upto = np.cumsum(saved)
        before = np.repeat(upto[begin] - saved[begin], rest) if len(rows) else upto
        below = total[of] - (upto - saved - before)
        return rows, hung, spine, total, of, depth, words, below

    def rows(self, slab: int) -> Iterator[dict[str, np.ndarray]]:
        """Columns of final nodes, then of the parts of spine nodes."""
        last = len(self.paths) - 1
        rows, hung, on_spine, total, of, depth, words, below = self._chains({0, last})
        count = len(self.parent)
        spine = np.zeros(count, dtype=bool)
        spine[self.sides[0] + self.sides[1]] = True
        # Children, leaves and savings below each node that no spine node gives itself.
        children = np.bincount(self.parent[1:][~spine[1:]], minlength=count) + np.bincount(hung[~on_spine], minlength=count)
        leaves = np.bincount(hung[~on_spine], minlength=count)
        saved = np.zeros(count, np.int64)
        np.add.at(saved, hung[~on_spine], total[~on_spine])
        leaves += ~spine & (children == 0)
        saved += np.where(spine, 0, (self.convs - 1) * self.own_words)
        borders = np.cumsum([0, *self.levels])
        for a, b in zip(borders[-2:0:-1].tolist(), borders[:0:-1].tolist()):
            np.add.at(leaves, self.parent[a:b], leaves[a:b])
            np.add.at(saved, self.parent[a:b], saved[a:b])
        node_depth = np.repeat(np.arange(len(self.levels)), self.levels)

        keys = [self._keys(0), self._keys(last)]
        parent_key = np.full(count, None, dtype=object)
        for side in (0, 1):
            for d, place in enumerate(self.sides[side]):
                parent_key[place] = keys[side][d]
        ends = np.array([*self.ends, None], dtype=object)
        at = np.flatnonzero(~spine)
        up = self.parent[at]
        yield {
            "conv_id": self.conv[at], "depth": node_depth[at], "parent_conv_id": np.where(spine[up], -1, self.conv[up]), "parent_known": ~spine[up],
            "n_convs": self.convs[at], "n_children": children[at], "n_leaves": leaves[at], "saved_tokens": saved[at],
            "ends": ends[self.end[at]], "parent": np.where(spine[up], parent_key[up], None),
        }
        keep = ~on_spine[of]
        row, of, depth, below = rows[of][keep], of[keep], depth[keep], below[keep]
        first = depth == self.tails[2][of] + 1
        up = hung[of]
        outside = first & spine[up]
        final = depth == self.size[row]
        yield {
            "conv_id": self.least[row], "depth": depth, "parent_conv_id": np.where(first, self.conv[up], self.least[row]), "parent_known": ~outside,
            "n_convs": self.n[row], "n_children": (~final).astype(np.int64), "n_leaves": np.ones(len(row), np.int64), "saved_tokens": below,
            "ends": ends[np.where(final, row, -1)], "parent": np.where(outside, parent_key[up], None),
        }

        shared = 0
        for side, row in ((0, 0), (1, last)):
            places, key, length = self.sides[side], keys[side], int(self.size[row])
            inner, tail = np.array(places), np.arange(len(places), length + 1)
            if side:
                shared = len(key) if last == 0 else sum(a == b for a, b in zip(*self.sides))
            own = np.arange(length + 1) >= shared
            zeros = np.zeros(len(tail), np.int64)
            columns = {
                "n_convs": np.r_[self.convs[inner], np.full(len(tail), self.n[row])],
                "conv_id": np.r_[self.conv[inner], np.full(len(tail), self.least[row])],
                "n_children": np.r_[children[inner], zeros], "n_leaves": np.r_[leaves[inner], zeros], "saved_tokens": np.r_[saved[inner], zeros],
                "words": np.r_[self.own_words[inner], self.words[row][tail - 1]],
            }
            stop = np.full(length + 1, None, dtype=object)
            stop[:len(places)] = ends[self.end[inner]]
            if len(tail):
                stop[-1] = self.ends[row]
            # A node on both sides is told by the first; the other only hands sums up through it.
            yield {
                **{c: np.where(own, columns[c], 0) for c in (*_COUNTS, "words")}, "conv_id": columns["conv_id"],
                "depth": np.arange(length + 1), "ends": np.where(own, stop, None), "node": np.array(key, dtype=object),
                "parent": np.array([None, *key[:-1]], dtype=object), "slab": np.full(length + 1, slab), "side": np.full(length + 1, side),
            }

    def _keys(self, row: int) -> list[bytes]:
        """The digest of each prefix of a row's path."""
        path, digest = self.paths[row], hashlib.md5()
        keys = [digest.digest()]
        for at in range(0, len(path), ID):
            digest.update(path[at:at + ID])
            keys.append(digest.copy().digest())
        return keys


def _as_batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    size = len(columns["depth"])
    for at in range(0, size, 20_000):
        part = {k: v[at:at + 20_000] for k, v in columns.items()}
        arrays = []
        for field in NODES:
            values = part.get(field.name)
            if values is None:
                arrays.append(pa.nulls(len(part["depth"]), field.type))
            elif field.name == "parent_conv_id":
                arrays.append(pa.array(values, field.type, mask=~part["parent_known"]))
            else:
                arrays.append(pa.array(values, field.type, from_pandas=values.dtype == object))
        yield pa.record_batch(arrays, schema=NODES)


def _grown(held: list[tuple], slab: int) -> Iterator[pa.RecordBatch]:
    paths, words, n, least, ends = zip(*held, strict=True)
    trie = Slab(list(paths), [np.frombuffer(w, "<i8") for w in words], np.array(n), np.array(least), list(ends))
    for columns in trie.rows(slab):
        yield from _as_batches(columns)


def _tries(slab_bytes: int):
    """Sorted rows (path, words, n, least, ends) to nodes, slab by slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight, slab = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                weight += len(row[0]) + len(row[1]) + 200
                if weight >= slab_bytes:
                    yield from _grown(held, slab)
                    held, weight, slab = [], 0, slab + 1
        if held:
            yield from _grown(held, slab)

    return run


def _recombined(parts: DataFrame) -> DataFrame:
    """The nodes of the spines from their parts, as ``node`` and the columns of a node."""
    owner = F.min(F.struct("slab", "side")).alias("owner")
    sums = stored(
        parts.groupBy("node").agg(
            *[F.sum(c).alias(c) for c in _COUNTS], F.max("words").alias("words"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"),
            F.first("depth").alias("depth"), F.max("parent").alias("parent"), owner,
        ),
        "spine-sums",
    )
    kids = sums.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    whole = sums.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    whole = stored(whole, "spine-nodes")
    own = whole.select(
        "node", "owner.slab", "owner.side",
        ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"), (F.col("n_children") == 0).cast("bigint").alias("own_leaf"),
    )
    below = Window.partitionBy("slab", "side").orderBy(F.col("depth").desc())
    climbed = parts.select("node", "slab", "side", "depth").join(own, ["node", "slab", "side"], "left")
    climbed = climbed.select("node", *[F.sum(F.coalesce(c, F.lit(0))).over(below).alias(c) for c in ("own_saved", "own_leaf")])
    climbed = climbed.groupBy("node").agg(F.sum("own_saved").alias("own_saved"), F.sum("own_leaf").alias("own_leaf"))
    return stored(
        whole.join(climbed, "node").select(
            "node", "conv_id", "depth", "parent", "n_convs", "n_children",
            (F.col("n_leaves") + F.col("own_leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("own_saved")).alias("saved_tokens"), "ends",
        ),
        "spine",
    )


def trie(paths: DataFrame, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, key, path, words), as the contract of the operator names them."""
    paths = stored(paths, "paths")
    distinct = paths.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"))
    rows = stored(distinct.join(ends_of(paths), "key").select("path", "words", "n", "least", "ends"), "distinct-paths")
    ranges = rows.repartitionByRange(F.substring("path", 1, RANGE_TURNS * ID)).sortWithinPartitions("path")
    nodes = stored(ranges.mapInArrow(_tries(slab_bytes), NODES_DDL), "trie-nodes")
    final = nodes.where("side is null")
    spine = _recombined(nodes.where("side is not null"))
    ups = spine.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    columns = ["conv_id", "depth", "parent_conv_id", *_COUNTS, "ends"]
    hung = final.where("parent is not null").drop("parent_conv_id").join(ups, "parent").withColumnRenamed("up", "parent_conv_id")
    top = spine.join(ups, "parent", "left").withColumnRenamed("up", "parent_conv_id")
    every = final.where("parent is null").select(*columns).union(hung.select(*columns)).union(top.select(*columns))
    return every.withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING))).drop("ends")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(conversations))
