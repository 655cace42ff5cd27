"""Substring dedup against a plain program, and the parts of its sketches."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from savora.llm import sketches, substring_dedup
from savora.llm.common import flagged


def slow(rows, width):
    """(doc_id, n_words, n_removed, kept) of every row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), ws in zip(rows, words, strict=True):
        for a in range(len(ws) - width + 1):
            key = tuple(ws[a:a + width])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    found = []
    for (i, _), ws in zip(rows, words, strict=True):
        gone = set()
        for a in range(len(ws) - width + 1):
            if i is not None and least[tuple(ws[a:a + width])] < i:
                gone.update(range(a, a + width))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        found.append((i, len(ws), len(gone), kept.encode()))
    return found


def table(rng):
    passage = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 90)) for _ in range(n)) for n in (13, 30, 200)]
    rows = []
    for i in range(120):
        parts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 40))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passage))
        rows.append((i * 3 - 20, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(5000 + i, passage[2]) for i in range(60)] + [(None, passage[1]), (None, None), (7000, None), (7001, ""), (7002, " \n")]
    # Ids that repeat, with equal and with other texts; a text that repeats within itself; few words; no-break blanks.
    rows += [(1, passage[0])] * 2 + [(8000, passage[1]), (8000, "x " + passage[2]), (8001, "la " * 400), (8002, "la " * 50), (8003, "a b"), (8004, "é " * 5 + passage[0])]
    rows.append((9000, " ".join(rng.choice("xyz") for _ in range(60_000))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, partitions", [(1, 1), (2, 7)])
def test_deduplicated(spark, seed, partitions):
    rows = table(random.Random(seed))
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], "doc_id long, text string, tag string, start long, runs long").repartition(partitions)
    found = substring_dedup.deduplicated(docs, width=13)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept"]
    found = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in found.collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(found, key=order) == sorted(slow(rows, 13), key=order)


def test_full_sketch_loses_nothing(spark):
    """With far too few cells for the windows all are grouped exactly."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("pqrstuvwxyz") for _ in range(200)) for _ in range(40)]
    rows = [(i, texts[i % 25] + " tail") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sketch = [np.full(sketches.LEAST_CELLS >> 3, 255, np.uint8)] * sketches.ROWS
    chunk = substring_dedup.Chunk(13)
    chunk.add([(i, 0, t.encode()) for i, t in rows])
    exact, runs = chunk.repeated(22, sketch)
    assert len(exact[0]) + runs[-1].sum() == chunk.windows
    found = {r.doc_id: r.n_removed for r in substring_dedup.deduplicated(docs, most_cells=1).collect()}
    assert all(found[i] == n for i, _, n, _ in slow(rows, 13))


def test_empty_table(spark):
    assert substring_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_are_coded_alike_wherever_they_stand():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab\u00e9\u00a0") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 200, 256, 257, 3000]))) for _ in range(400)]
    text = "".join(w + rng.choice([" ", "\n\t", "\x0b\x0c", "\r "]) for w in words + words[::-1]).encode()
    begin, codes = substring_dedup.word_codes(text)
    assert [text[a:].split(None, 1)[0].decode() for a in begin] == words + words[::-1]
    assert (codes == codes[::-1]).all() and len({tuple(c) for c in codes.tolist()}) == len(set(words))
    assert len({c for c in codes[:, 0].tolist()}) == len({c for c in codes[:, 1].tolist()}) == len(set(words))
    for empty in (b"", b" \n"):
        assert len(substring_dedup.word_codes(empty)[0]) == 0


@pytest.mark.parametrize("shift", [0, 3, 8, 13])
def test_cells_come_back(shift):
    rng = np.random.default_rng(shift)
    for n in (0, 1, 7, 5000):
        cells = np.unique(rng.integers(0, 1 << 22, n)).astype(np.uint64)
        assert (sketches.unpacked_cells(sketches.packed_cells(cells, shift), shift) == cells.astype(np.int64)).all()


def test_estimates_are_never_too_low():
    """Every window that two documents share is flagged by the merged sketches of all chunks."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("pqrstuvwxyz") for _ in range(300)).encode() for _ in range(30)]
    chunks = []
    for part in range(3):
        chunk = substring_dedup.Chunk(5)
        chunk.add([(i, 0, texts[i % 12]) for i in range(part, 30, 3)])
        chunks.append(chunk)
    for row in range(sketches.ROWS):
        met = np.zeros(1 << 22, np.int64)
        for chunk in chunks:
            np.add.at(met, sketches.cell_of(chunk.distinct(), row, 22).astype(np.int64), 1)
        windows = {}
        for chunk in chunks:
            for h, d in zip(np.concatenate(chunk.first), np.concatenate(chunk.doc)):
                windows.setdefault(int(h), set()).add(chunk.ids[d])
        assert all(met[int(sketches.cell_of(np.array([h], np.uint64), row, 22)[0])] >= len(ids) for h, ids in windows.items())


def test_workers_hold_little(spark, monkeypatch):
    """Windows that are not repeated are not held, a chunk's arrays take few bytes, and no sketch outlives its task."""
    rng = random.Random(11)
    passage = " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(40))
    rows = [(i, " ".join([*(f"w{rng.randint(0, 10**9)}" for _ in range(300)), *([passage] * (i % 10 == 0))])) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).selectExpr("doc_id", "0L tag", "text")
    bits = sketches.LEAST_CELLS.bit_length() - 1
    path = sketches.merged(docs.mapInArrow(substring_dedup._sketched(13, bits), sketches.PARTS_DDL), sketches.ROWS, sketches.FINER)
    chunks, whole = [], substring_dedup.Chunk
    monkeypatch.setattr(substring_dedup, "Chunk", lambda *a, **b: chunks.append(whole(*a, **b)) or chunks[-1])
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([t for _, t in rows])], names=["doc_id", "tag", "text"])
    found = list(substring_dedup._candidates(13, bits, path)(iter([batch])))
    assert sum(len(c.ids) for c in chunks) == 1000 and len(chunks) == 1
    # 28 windows of the passage stand in 100 documents; few others may be taken for repeated.
    assert 2800 <= sum(c.windows for c in chunks) <= 4000
    assert sum(x.nbytes for c in chunks for part in (c.first, c.second, c.doc, c.start) for x in part) == 24 * chunks[0].windows
    assert sum(b.num_rows for b in found) >= 28 + 99 and not sketches._LOADED


@pytest.mark.parametrize("finer, n_rows", [(0, 1), (sketches.FINER, 2)])
def test_merged_sketch(spark, finer, n_rows):
    """What occurs in two chunks is flagged; of 400 000 hashes that occur once, counted finely, hardly one is."""
    rng = np.random.default_rng(4)
    twice = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    chunks = [np.concatenate([twice, rng.integers(0, 1 << 64, 200_000, dtype=np.uint64)]) for _ in range(2)]
    parts = [(p, s, bytes(a), bytes(b)) for c in chunks for p, s, a, b in sketches.of(c, 22, finer)]
    path = sketches.merged(spark.createDataFrame(parts, sketches.PARTS_DDL), n_rows, finer)
    sketch = sketches.load(path, 22, n_rows)
    assert sketches.repeated(twice, 22, sketch).all()
    others = np.concatenate([c[20_000:] for c in chunks])
    assert sketches.repeated(others, 22, sketch).mean() < (0.01 if finer else 0.2)
    sketches.forget()


def test_flagged(spark):
    """Every id of the list is flagged, hardly any other, and no row is lost or comes twice."""
    rows = spark.createDataFrame([(i if i % 7 else None, i) for i in range(3000)] + [(1, -1)], "doc_id long, x long")
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 5)] + [(5,)], "doc_id long")
    found = [tuple(r) for r in flagged(rows, ids, "perhaps").collect()]
    assert sorted(x for _, x, _ in found) == [-1, *range(3000)]
    assert all(p for i, _, p in found if i is not None and i % 5 == 0) and sum(p for i, _, p in found if i and i % 5) < 10
    assert not any(p for _, _, p in flagged(rows, ids.limit(0), "perhaps").collect())
