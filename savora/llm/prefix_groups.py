"""Jaccard join on word shingles by grouped prefixes.

A document is the set of its distinct word shingles, each a 64-bit hash. A count-min sketch over every other shingle of
all documents tells many of those that stand in one document only; the global order puts these first, then the rest,
each part by hash. Two sets as similar as wanted share a member of their prefixes, the first `size - least overlap + 1`
members, and shingles of one document are never shared, so most documents that are no near copies have nothing to post. Documents with equal sets are one; sets with the same prefix and size are one group, and only
groups are posted under their prefix members, with their size and the member's place in the prefix.

Of lists with the same groups one is kept: near copies share most of their prefixes, and would meet once for each
member. In a list, pairs of groups are filtered by size and by what the member's places leave to
share; only the groups of pairs that pass are expanded to their sets, of which pairs are filtered by a bound on the
overlap from parity sketches. Each of these filters passes every pair that is similar enough. What is left,
clusters of sets with possible partners, is verified set against set on the whole texts.

A pair whose two sets already hang together needs no verification, as only classes are asked for; links are
taken into a forest as they are found, and no task keeps or emits pairs. Lists are worked on in blocks of a bounded
number of sets, so neither a large group of near copies nor a passage that many documents share lands in one task.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A document with fewer words than a shingle has the
whole sequence as its only member; one without words has the empty set and links with nothing, like a
null text. Documents without an id link with nothing and have no class. Repeated rows are equal sets, and rows that
repeat an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.llm import lists, sketches
from savora.llm.common import perhaps_in, record_batches
from savora.llm.components import components
from savora.llm.substring_dedup import word_codes
from savora.session import stored

# Sets of a chunk that is filtered and of one that is verified, sets of a row, and pairs looked at together.
MOST_POSTINGS, MOST_SETS, MOST_MEMBERS, MOST_PAIRS = 4096, 2048, 64, 1 << 20
# Shingles of a partial sketch, and bytes of text whose words are looked at together.
CHUNK_MEMBERS, BLOCK_BYTES = 1 << 20, 2 << 20
# Bytes of text in a chunk that is verified.
MOST_BYTES = 1 << 26
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("gid", pa.int64()), ("lead", pa.int64()), ("shared", pa.list_(pa.int64())), ("sketch", pa.binary()), ("size", pa.int64())]
)
SETS_DDL = "doc_id bigint, n bigint, s1 bigint, s2 bigint, gid bigint, lead bigint, shared array<bigint>, sketch binary, size bigint"
CLUSTERS = pa.schema([("label", pa.int64()), ("rep", pa.int64())])
CLUSTERS_DDL = "label bigint, rep bigint"
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
EDGES_DDL = "a bigint, b bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    total = np.full(len(codes) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        total = _mixed(total * _ODD[0] + codes[j:len(codes) - size + 1 + j])
    return np.unique(total)


def least_overlap(n: int, percent: int) -> int:
    """The smallest intersection a set of n can have with a partner."""
    return (percent * n + 99) // 100


def sketch_class(n: np.ndarray, percent: int) -> np.ndarray:
    """How often 512 bits are doubled so that sets of n too far apart show it.

    Sets that share nothing differ in about half the bits, which must be well above what is allowed.
    """
    wanted = np.maximum(np.asarray(n) * (100 - percent) / 20, 512)
    return np.ceil(np.log2(wanted / 512)).astype(np.int64)


def sketch(members: np.ndarray, percent: int) -> np.ndarray:
    """The parity of the members that fall on each bit, packed.

    Two sketches differ in at most as many bits as their sets do in members.
    """
    size = 512 << int(sketch_class(len(members), percent))
    places = (_mixed(members * _ODD[1]) >> np.uint64(65 - size.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=size) & 1).astype(np.uint8))


class Sketches:
    """Sketches of different sizes, compared at the smaller of two; a larger one is folded once."""

    def __init__(self, packed: list[bytes], classes: np.ndarray):
        self.classes = classes
        self.words: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        for c in np.unique(classes).tolist():
            own, next_ = np.flatnonzero(classes == c), np.flatnonzero(classes == c + 1)
            rows = [np.frombuffer(b"".join(packed[i] for i in own.tolist()), dtype=np.uint64).reshape(len(own), -1)]
            if len(next_):
                bits = np.unpackbits(np.frombuffer(b"".join(packed[i] for i in next_.tolist()), dtype=np.uint8))
                halves = bits.reshape(len(next_), -1, 2)
                rows.append(np.packbits(halves[:, :, 0] ^ halves[:, :, 1], axis=1).view(np.uint64))
            self.words[c] = np.concatenate(rows)
            self.place[c] = np.full(len(classes), -1)
            self.place[c][np.concatenate([own, next_])] = np.arange(len(own) + len(next_))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits each pair differs; b's class is a's or the next."""
        found = np.zeros(len(a), dtype=np.int64)
        for c in np.unique(self.classes[a]).tolist():
            at = np.flatnonzero(self.classes[a] == c)
            words, place = self.words[c], self.place[c]
            found[at] = np.bitwise_count(words[place[a[at]]] ^ words[place[b[at]]]).sum(axis=1, dtype=np.int64)
        return found


def _digest(members: np.ndarray, odd: np.uint64) -> int:
    with np.errstate(over="ignore"):
        return int(np.add.reduce(_mixed(members * odd), dtype=np.uint64).astype(np.int64))


class Members(NamedTuple):
    """Sets of some documents: all members, sorted within each set, and where each set ends."""

    ids: list
    sizes: list[int]
    members: np.ndarray
    ends: np.ndarray


def _members_of(rows: list[tuple[int | None, bytes]], width: int) -> Members:
    places, codes = word_codes(b" ".join(text.translate(_LOWER) for _, text in rows))
    codes = codes[:, 0]
    stop = np.searchsorted(places, np.cumsum([len(text) + 1 for _, text in rows]))
    words = np.diff(stop, prepend=0)
    n = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(rows)), n)
    at = np.repeat(stop - words, n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(words, width)[doc]
    total = size.astype(np.uint64)
    for j in range(width):
        open_ = slice(None) if (size > j).all() else np.flatnonzero(size > j)
        total[open_] = _mixed(total[open_] * _ODD[0] + codes[at[open_] + j])
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.ones(len(total), dtype=bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return Members([i for i, _ in rows], [len(t) for _, t in rows], total[new], np.cumsum(np.bincount(doc[new], minlength=len(rows))))


def _blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Members]:
    """Rows (doc_id, text) as sets, some documents at a time."""
    held: list[tuple[int | None, bytes]] = []
    weight = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
            held.append((doc_id, text.as_py() or b""))
            weight += len(held[-1][1])
            if weight >= BLOCK_BYTES or len(held) == 10_000:
                yield _members_of(held, width)
                held, weight = [], 0
    if held:
        yield _members_of(held, width)


def _sampled(members: np.ndarray) -> np.ndarray:
    """Every other shingle, by hash: enough to fill the prefix of a document of its own."""
    return (members & np.uint64(1)).astype(bool)


def _hashed(members: np.ndarray) -> np.ndarray:
    return _mixed(members * _ODD[1])


def _sketched(width: int, bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, size = [], 0
        for block in _blocks_of(batches, width):
            held.append(_hashed(block.members[_sampled(block.members)]))
            size += len(held[-1])
            if size >= CHUNK_MEMBERS:
                yield from sketches.of(np.concatenate(held), bits)
                held, size = [], 0
        if size:
            yield from sketches.of(np.concatenate(held), bits)

    return lambda batches: record_batches(rows(batches), sketches.PARTS)


def _sets(width: int, percent: int, bits: int, path: str):
    """Sets with their prefixes; of these only the members that other documents may have are given out, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches, width):
            members, sampled = block.members, _sampled(block.members)
            alone = np.zeros(len(members), dtype=bool)
            alone[sampled] = ~sketches.repeated(_hashed(members[sampled]), bits, sketches.load(path, bits, 1))
            rows, start = [], 0
            for doc_id, size, stop in zip(block.ids, block.sizes, block.ends.tolist(), strict=True):
                own, first, start = members[start:stop], alone[start:stop], stop
                n = len(own)
                if n == 0:
                    rows.append((doc_id, 0, 0, 0, 0, 0, [], b"", size))
                    continue
                length = n - least_overlap(n, percent) + 1
                at_front = min(int(first.sum()), length)
                shared = own[~first][:length - at_front]
                prefix = np.concatenate([own[first][:at_front], shared])
                group = _digest(np.append(prefix, np.uint64(n)), _ODD[2])
                rows.append((
                    doc_id, n, _digest(own, _ODD[0]), _digest(own, _ODD[2]), group, int(prefix[:1].view(np.int64)[0]),
                    shared.view(np.int64), sketch(own, percent).tobytes(), size,
                ))
            for at in range(0, len(rows), 1000):
                part = rows[at:at + 1000]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part), SETS, strict=True)], schema=SETS)

    return run


def least_common(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of sets of these sizes that are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def _expanded(a: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of sets of these pairs of rows, some at a time; of a row with itself each pair once."""
    count = size[a] * size[b]
    cuts = np.searchsorted(np.cumsum(count), np.arange(MOST_PAIRS, int(count.sum()) + MOST_PAIRS, MOST_PAIRS), "right")
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
        x, y, many = a[start:stop], b[start:stop], count[start:stop]
        pair = np.repeat(np.arange(len(x)), many)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        left, right = begin[x[pair]] + at // size[y[pair]], begin[y[pair]] + at % size[y[pair]]
        once = (x[pair] != y[pair]) | (left < right)
        yield left[once], right[once]


def _clusters(percent: int):
    """Of blocks of groups under a shared prefix member, the clusters of sets that may have partners."""

    def run(some: pa.RecordBatch, starts: np.ndarray) -> dict:
        names = some.schema.names
        n, place, gid = (some.column(names.index(c)).to_numpy() for c in ("n", "place", "gid"))
        groups = some.column(names.index("members"))
        members = groups.flatten()
        reps, packed = members.field("rep").to_numpy(), members.field("sketch").to_pylist()
        size = np.diff(groups.offsets.to_numpy())
        begin = np.cumsum(size) - size
        block = np.searchsorted(starts, np.arange(some.num_rows), "right")
        order = np.lexsort((n, block))
        block, n, place, gid, size, begin, side = block[order], n[order], place[order], gid[order], size[order], begin[order], lists.sides(some)[order]
        of = np.zeros(len(reps), dtype=np.int64)
        of[np.repeat(begin, size) + np.arange(len(reps)) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(n, size)
        compared, forest, met = Sketches(packed, sketch_class(of, percent)), lists.Forest(len(reps)), np.zeros(len(reps), dtype=bool)

        def expand(a: np.ndarray, b: np.ndarray) -> None:
            for x, y in _expanded(a, b, begin, size):
                open_ = forest.apart(x, y)
                x, y = x[open_], y[open_]
                near = (100 + percent) * compared.apart(x, y) <= (100 - percent) * (of[x] + of[y])
                forest.link(x[near], y[near])
                met[x[near]] = met[y[near]] = True

        # A place of -1 marks the list of one group's own rows, each compared with itself too.
        inner = np.flatnonzero((place < 0) & (size > 1) & (side == 0))
        expand(inner, inner)
        for a, b in lists.steps(block, n, side, percent):
            left = np.minimum(place[a], place[b]) + 1 + np.minimum(n[a] - place[a], n[b] - place[b]) - 1
            fit = np.where(place[a] < 0, True, (gid[a] != gid[b]) & (left >= least_common(n[a], n[b], percent)))
            expand(a[fit], b[fit])
        least = np.full(len(reps), np.iinfo(np.int64).max)
        np.minimum.at(least, forest.top, reps)
        return {"label": least[forest.top][met], "rep": reps[met]}

    return run


def _verified(width: int, percent: int):
    """Of blocks of sets, edges that connect all those similar enough."""

    def run(some: pa.RecordBatch, starts: np.ndarray) -> dict:
        names = some.schema.names
        reps, side = some.column(names.index("rep")).to_numpy(), lists.sides(some)
        texts = some.column(names.index("text")).cast(pa.large_binary())
        edges = []
        for start, stop in zip(starts.tolist(), starts[1:].tolist()):
            sets = [shingles(t.as_py() or b"", width) for t in texts[start:stop]]
            order = np.argsort([len(s) for s in sets], kind="stable")
            sets, own, sides = [sets[i] for i in order.tolist()], reps[start:stop][order], side[start:stop][order]
            n = np.array([len(s) for s in sets], dtype=np.int64)
            compared = Sketches([sketch(s, percent).tobytes() for s in sets], sketch_class(n, percent))
            forest = lists.Forest(len(sets))
            for x, y in lists.steps(np.zeros(len(n), np.int64), n, sides, percent):
                open_ = forest.apart(x, y)
                x, y = x[open_], y[open_]
                near = (100 + percent) * compared.apart(x, y) <= (100 - percent) * (n[x] + n[y])
                for at in np.flatnonzero(near).tolist():
                    pair = x[at:at + 1], y[at:at + 1]
                    if not forest.apart(*pair)[0]:
                        continue
                    a, b = int(x[at]), int(y[at])
                    common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        forest.link(*pair)
            # Each set hangs on the smallest id of its tree, as stars settle in few rounds.
            least = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(least, forest.top, own)
            hung = np.flatnonzero(least[forest.top] != own)
            edges.append(np.stack([own[hung], least[forest.top][hung]], axis=1))
        found = np.concatenate([np.zeros((0, 2), np.int64), *edges])
        return {"a": found[:, 0], "b": found[:, 1]}

    return run


def _lists(heads: DataFrame, percent: int) -> DataFrame:
    """Postings (member, gid, n, place) of one row a group, one list of each set of groups that share a member."""
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    # Places count from the end, as members of one document come first and are not given out.
    place = length - F.size("shared") + F.col("at")
    postings = heads.select("gid", "n", "shared", F.posexplode("shared").alias("at", "member"))
    postings = stored(postings.select("member", "gid", "n", place.cast("bigint").alias("place")), "prefix-postings")
    marks = [F.bit_xor(F.xxhash64("gid", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    each = postings.groupBy("member").agg(F.count("*").alias("groups"), *marks).where("groups > 1")
    kept = stored(each.groupBy("groups", "x1", "x2").agg(F.min("member").alias("member")).select("member"), "lists")
    return postings.join(kept, "member")


def classes(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document, by sets of ``width`` words at ``percent`` % Jaccard."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # About two cells for each shingle that is counted.
    bits = sketches.bits_for((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 32)
    path = sketches.merged(rows.mapInArrow(_sketched(width, bits), sketches.PARTS_DDL))
    sets = stored(rows.mapInArrow(_sets(width, percent, bits, path), SETS_DDL), "sets")
    same = ["s1", "s2", "n"]
    distinct = stored(
        sets.where("n > 0 and doc_id is not null")
        .groupBy(*same)
        .agg(F.min_by(F.struct("gid", "lead", "shared", "sketch"), "doc_id").alias("r"), F.min("doc_id").alias("rep"))
        .select(*same, "rep", "r.*"),
        "distinct-sets",
    )
    # The sets of each group, in rows of a bounded number of them. Two groups of one digest would be told apart by
    # their size and first member, and be compared as one.
    group = ["gid", "n", "lead"]
    sizes = distinct.groupBy(*group).agg(F.count("*").alias("in_group"), F.min("rep").alias("head"))
    sizes = stored(sizes.where("in_group > 1"), "group-sizes")
    grouped = distinct.join(sizes, group, "left")
    postings = stored(_lists(grouped.where("(head is null or rep = head) and size(shared) > 0").select("gid", "n", "shared"), percent), "postings")
    # Only groups that meet others, or have several sets, are needed from here on.
    wanted = postings.select("gid", "n").union(sizes.select("gid", "n")).distinct()
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.coalesce("in_group", F.lit(1)) / MOST_MEMBERS))
    units = (
        grouped.join(wanted, ["gid", "n"], "left_semi")
        .groupBy("gid", "n", part.alias("part"))
        .agg(F.collect_list(F.struct("rep", "sketch")).alias("members"))
        .select("gid", "n", F.xxhash64("gid", "n", "part").alias("unit"), F.size("members").cast("bigint").alias("held"), "members")
    )
    units = stored(units, "units")
    posted = postings.join(units.select("gid", "n", "unit", "held"), ["gid", "n"]).select("member", "gid", "place", "unit", "held")
    # Groups of several sets are also compared within themselves.
    own = units.join(sizes.select("gid", "n").distinct(), ["gid", "n"], "left_semi")
    own = own.select(F.xxhash64("gid", "n", F.lit("own")).alias("member"), "gid", F.lit(-1).cast("bigint").alias("place"), "unit", "held")
    listed = stored(posted.union(own), "list-rows")
    placed = lists.blocks(listed, "member", "unit", MOST_POSTINGS, "list-sizes", "held", MOST_POSTINGS)
    single = own.groupBy("member").agg(F.count("*").alias("rows")).where("rows = 1").select("member")
    columns = ["member", "i", "k", "chunk", "gid", "place", "unit"]
    alone = own.join(single, "member").withColumns({c: F.lit(0) for c in ("i", "k", "chunk")})
    met = placed.select(*columns).union(alone.select(*columns))
    met = met.join(units.select("unit", "n", "members"), "unit").select("member", "i", "k", "chunk", "gid", "n", "place", "members")
    clusters = lists.compared(met, "member", _clusters(percent), CLUSTERS, CLUSTERS_DDL)
    # Clusters that share a set become one, so that each text is needed once.
    hung = components(clusters)
    linked = hung.select(F.col("component").alias("label"), F.col("id").alias("rep"))
    clusters = stored(linked.union(hung.select("component", "component").distinct()), "clusters")
    # With what the texts of a set's first id weigh; copies of a text are read once.
    weighed = sets.where("n > 0").join(clusters.withColumnRenamed("rep", "doc_id"), "doc_id").groupBy("label", "doc_id", *same).agg(F.max("size").alias("size"))
    weighed = stored(weighed.groupBy("label", F.col("doc_id").alias("rep")).agg(F.sum("size").alias("size")), "weighed-clusters")
    chosen = lists.blocks(weighed, "label", "rep", MOST_SETS, "cluster-sizes", "size", MOST_BYTES)
    near = clusters.select("rep")
    texts = rows.where(perhaps_in(near)).join(near, rows["doc_id"] == near["rep"], "left_semi").distinct()
    verified = chosen.join(texts, chosen["rep"] == texts["doc_id"]).select("label", "i", "k", "chunk", "rep", "text")
    hung = components(lists.compared(verified, "label", _verified(width, percent), EDGES, EDGES_DDL))
    of_set = stored(
        distinct.select(*same, "rep").join(hung.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("c")),
        "set-classes",
    )
    ids = sets.select("doc_id", *same)
    linked = ids.where("n > 0 and doc_id is not null").join(of_set, same).select("doc_id", "n", "c")
    alone = ids.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("c"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns; documents without an id all stay.

    Rows that repeat the smallest id all stay.
    """
    gone = classes(docs, width, percent, text).where("doc_id <> component_id").select(F.col("doc_id").alias("gone__")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["gone__"], "left_anti")
