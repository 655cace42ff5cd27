"""The registered queries beyond SQL, and the pipeline, against plain programs over the smallest tables."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import base_spans, ids_of, library, slow_classes

import corpus_pipeline
from savora.llm import repetition, toxicity
from savora.llm.common import table
from savora.llm.queries import QUERIES
from savora.llm.secret_ledger import RULES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()}


@pytest.fixture(scope="module")
def byte_ids(texts):
    plain = library(BYTE)
    return {i: ids_of(plain, t) for i, t in texts.items()}


def test_op3(spark):
    docs = duckdb.sql(f"select doc_id, text, source from '{FOLDER}/documents.parquet'").fetchall()
    strata = collections.defaultdict(list)
    for i, t, source in docs:
        stratum = hashlib.md5(("s" + ("=" + source if source is not None else "-")).encode()).hexdigest()
        strata[stratum].append((hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    order = []
    for stratum, rows in strata.items():
        shift = int(hashlib.md5(f"7|{stratum}".encode()).hexdigest()[:8], 16) / 2.0**32
        order += [((rank + shift) / len(rows), stratum, i) for rank, (_, i) in enumerate(sorted(rows))]
    expected = {}
    for position, (_, _, i) in enumerate(sorted(order)):
        shard = position * 40 // len(docs)
        expected[i] = (shard, position - -(-shard * len(docs) // 40))
    data = {i: (t or "").encode() for i, t, _ in docs}
    rows = QUERIES["op3_interleave"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(expected)
    for r in rows:
        assert (r["shard"], r["slot"], r["law"], r["grown_shard"]) == (*expected[r["doc_id"]], "rows", None)
        assert (r["size"], r["text_crc32"]) == (len(data[r["doc_id"]]) + 16, zlib.crc32(data[r["doc_id"]]))


def test_op6(spark, texts):
    plain = library(WORD)
    rows = QUERIES["op6_bpe_cuts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(plain, texts[r.doc_id])
        decoded = plain.decode(ids.tolist(), skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_op7(spark, texts, byte_ids):
    rows = sorted(QUERIES["op7_token_shards"](spark, FOLDER).collect(), key=lambda r: r.doc_id)
    at = 0
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = np.append(byte_ids[r.doc_id], np.uint32(2)).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op8(spark):
    rows = QUERIES["op8_toxicity"](spark, FOLDER).collect()
    labels = dict(duckdb.sql(f"select doc_id, max(toxic) from '{FOLDER}/labels.parquet' group by 1").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_op10(spark, texts, byte_ids):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op10_packing"](spark, FOLDER).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = np.append(byte_ids[i], np.uint32(0)).astype("<u4"), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= 1024


def without_secrets(text):
    """Base and further spans replaced by their kind; spans that overlap become one."""


    spans = [(a, k, b, kind) for k, kind in enumerate(("assign", "access", "hex")) for a, b in base_spans(text)[kind]]
    spans += [(m.start(), 3 + k, m.end(), r.kind) for k, r in enumerate(RULES[3:]) for m in re.finditer(r.pattern, text)]
    out, at = [], 0
    for a, _, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_pipeline(spark, texts):
    docs = table(spark, FOLDER, "documents")
    model = toxicity.learn(docs, table(spark, FOLDER, "labels"))
    matcher = toxicity.Matcher(list(model.terms))
    kept = {i: t for i, t in texts.items() if model.score(toxicity.features(t, matcher)) < 0.5}
    assert 0 < len(texts) - len(kept) < 0.3 * len(texts)
    kept = {i: t for i, t in kept.items() if repetition.measure(t.encode())["kept"]}
    classes = slow_classes(list(kept.items()), 5, 80)
    expected = {i: without_secrets(t) for i, t in kept.items() if classes[i][1] == i}
    plain, found = library(BYTE), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        found[r.doc_id].append((r.start, bytes(r.ids)))
    assert set(found) == set(expected)
    for i, own in found.items():
        assert b"".join(ids for _, ids in sorted(own)) == ids_of(plain, expected[i]).tobytes() + b"\0\0\0\0"


def test_stages_keep_columns_and_handle_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, FOLDER)
            assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
            rows = spark.createDataFrame(rows.collect(), docs.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER)
        assert pieces.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()



def test_labels_are_no_input_of_a_score(spark):
    docs = table(spark, FOLDER, "documents")
    model = toxicity.learn(docs, table(spark, FOLDER, "labels"))
    first = docs.select("doc_id", toxicity.scores(model).alias("s"))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")).withColumn("doc_id", F.col("doc_id") + 1)
    assert sorted(r.s for r in first.collect()) == sorted(r.s for r in other.select(toxicity.scores(model).alias("s")).collect())
