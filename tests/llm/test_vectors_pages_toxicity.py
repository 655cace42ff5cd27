import base64
import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from savora.llm import cap_filters, lists, toxicity, warc_salvage
from savora.llm.common import open_folder
from savora.llm.components import components
from savora.session import scratch_path


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(6000, 6200)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {i: top(i) for i in up if top(i) != i}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def slow_links(rows, threshold=0.95):
    sound = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in sound if j != i and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= threshold} for i in sound}
    result = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        result[i] = (len(links.get(i, ())), min(seen) if i is not None else None)
    return result


def test_cap_filters(spark):
    """Groups of near and exact copies, odd vectors, and blocks so small that lists are split."""
    rng = np.random.default_rng(1)
    rows, base = [], rng.normal(size=(30, 16))
    for i in range(400):
        v = base[i % 30] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15), (1003, [float("nan")] * 16), (1004, [float("inf")] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e-30] * 16), (1009, [1e30] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(frame, directions=64, reach=0.7, most=8).collect()}
    assert found == slow_links(rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cap_filters.near_vectors(empty).count() == 0


@pytest.mark.parametrize("most", [cap_filters.MOST, 200])
def test_cap_filters_on_one_large_group(spark, most):
    """Lists longer than a run of filters and a tile of rows, whole and dealt into blocks."""
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.normal(size=64) + 0.2 * rng.normal(size=(600, 64)), rng.normal(size=(300, 64))]).astype(np.float32)
    rows = list(zip(rng.permutation(900).tolist(), vectors.tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    ids = np.array([r[0] for r in rows])
    label = lists.local_components(np.nonzero(near), ids)
    wanted = {i: (n, c) for i, n, c in zip(ids.tolist(), (near.sum(axis=1) - 1).tolist(), label.tolist())}
    assert near.sum() > 100_000
    assert {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(frame, most=most).collect()} == wanted


def test_repeated_and_missing_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None), (3, [0.0, 1.0])]
    found = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == collections.Counter(
        [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False), (None, 0, None, False), (3, 0, 3, True)]
    )


def test_recall_of_the_default_filters():
    """Pairs at exactly the threshold, the hardest there are."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    a, b = (cap_filters.decoded(v, 512, 0.88, 11) for v in (x, y))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.99


def test_filters_are_all_that_exceed_the_bar():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(5, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rotation, first, second = cap_filters.code(8, 16, 1)
    scores = ((v @ rotation)[:, :4] @ first.T)[:, :, None] + ((v @ rotation)[:, 4:] @ second.T)[:, None, :]
    for found, s in zip(cap_filters.decoded(v, 16, 0.6, 1), scores):
        assert found.tolist() == np.flatnonzero(s.ravel() >= 0.6 * s.max() - 1e-12).tolist()


def test_local_components():
    label = lists.local_components((np.array([0, 3]), np.array([2, 2])), np.array([7, 1, 9, 3, 4]))
    assert label.tolist() == [3, 1, 3, 3, 4]
    chain = np.random.default_rng(0).permutation(500)
    label = lists.local_components((chain[:-1], chain[1:]), np.arange(500) + 7)
    assert label.tolist() == [7] * 500


def digest(html):
    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


PAGES = [(1, "u1", "<p>é</p>"), (2, "u\r\n2", "<p>é</p>"), (3, None, ""), (4, "u", None), (5, "u", "WARC/1.1\r\n fake \x1f\x8b\x08 start"), (6, "u", "x" * 300_000), (7, "u", "<p>é</p>")]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha1", F.lit("x"))
    rows = warc_salvage.read_archives(warc_salvage.write_archives(pages, compress=compress, archive_bytes=2000)).collect()
    assert not any(r.quarantined for r in rows)
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, r.payload) for r in rows}
    for i, _, html in PAGES:
        html = html or ""
        first = min(j for j, _, h in PAGES if (h or "") == html)
        expected = ("response", None) if first == i else ("revisit", first)
        assert found[i][:4] == (*expected, digest(html), len(html.encode()))
        assert found[i][4] == (html.encode() if first == i else None)


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc"), (None, "u", "abc"), (3, "u", "abc")], "page_id long, url string, html string")
    rows = warc_salvage.read_archives(warc_salvage.write_archives(pages, least_bytes=3)).collect()
    found = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert found == collections.Counter({(1, "response", None): 1, (2, "response", None): 1, (3, "response", None): 2, (4, "revisit", 3): 1, (None, "revisit", 3): 1})
    assert warc_salvage.read_archives(warc_salvage.write_archives(pages.limit(0))).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, count, start):
        return self.data[start:start + count]


def archive(compress):
    records = [warc_salvage.record(i, f"u{i}", f"page {i} ".encode() * (i + 1), warc_salvage.digest_of(f"page {i} ".encode() * (i + 1)), None, False) for i in range(12)]
    return [warc_salvage._member(r) if compress else r for r in records]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("block", [64, 1 << 20])
def test_salvage(compress, block):
    """Whatever is damaged, all other records are read and the gaps cover exactly the damage."""
    rng = random.Random(6)
    for trial in range(60):
        parts = archive(compress)
        hurt = sorted(rng.sample(range(12), rng.randint(1, 4)))
        for i in hurt:
            kind = rng.choice(["cut", "flip", "junk", "gone"])
            body = bytearray(parts[i])
            if kind == "cut":
                body = body[:rng.randrange(1, len(body) - 8)]
            elif kind == "flip":
                body[rng.randrange(12 if compress else 0, len(body) - 8)] ^= 0xFF
            elif kind == "junk":
                body = bytearray(rng.randbytes(50))
            else:
                body = bytearray(b"\x1f\x8b\x08WARC/1.1\r\n")
            parts[i] = bytes(body)
        data = b"".join(parts)
        rows = list(warc_salvage.salvage(warc_salvage.Source(Bytes(data), block)))
        assert sum(n for _, n, _, _ in rows) == len(data) and [s for s, *_ in rows] == [sum(n for _, n, _, _ in rows[:i]) for i in range(len(rows))]
        read = [r["page_id"] for _, _, r, _ in rows if r]
        assert set(range(12)) - set(hurt) <= set(read), (compress, hurt, read)
        assert all(r["payload"] == f"page {r['page_id']} ".encode() * (r["page_id"] + 1) for _, _, r, _ in rows if r)
        assert all(reason for _, _, r, reason in rows if r is None)


@pytest.mark.parametrize("seed", range(5))
def test_salvage_of_mixed_archives(seed):
    """Members and plain records in one file, a byte changed anywhere, stray starts: nothing good is lost, nothing damaged is read."""
    rng = random.Random(seed)
    for trial in range(250):
        parts = [rng.choice(pair) for pair in zip(archive(True), archive(False), strict=True)]
        hurt = sorted(rng.sample(range(12), rng.randint(1, 5)))
        for i in hurt:
            body = bytearray(parts[i])
            kind = rng.randrange(5)
            if kind == 0:
                body = body[:rng.randrange(0, len(body))]
            elif kind == 1:
                for _ in range(rng.randint(1, 3)):
                    body[rng.randrange(len(body))] ^= rng.randrange(1, 256)
            elif kind == 2:
                body = bytearray(rng.choice([b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\n"]) + rng.randbytes(40))
            elif kind == 3:
                body[:3] = b"\x1f\x8b\x08"
            else:
                body = bytearray(bytes(body).replace(b"Digest", b"Digesu").replace(b"page", b"pagf"))
            parts[i] = bytes(body)
        data = b"".join(parts)
        rows = list(warc_salvage.salvage(warc_salvage.Source(Bytes(data), rng.choice([64, 1000, 1 << 20]))))
        assert sum(n for _, n, _, _ in rows) == len(data)
        read = [r["page_id"] for _, _, r, _ in rows if r]
        assert set(range(12)) - set(hurt) <= set(read) and len(set(read)) == len(read), (hurt, read)
        assert all(r["payload"] == f"page {r['page_id']} ".encode() * (r["page_id"] + 1) and r["url"] == f"u{r['page_id']}" for _, _, r, _ in rows if r)


def test_archives_of_others_need_no_header_digest():
    signed = archive(False)[3]
    foreign = b"".join(line for line in signed.splitlines(True) if b"Header-Digest" not in line)
    read = lambda data, **how: [r for _, _, r, _ in warc_salvage.salvage(warc_salvage.Source(Bytes(data)), **how) if r]
    assert not read(foreign) and read(foreign, signed=False)[0]["page_id"] == 3
    assert not read(foreign.replace(b"Page-ID: 3", b"Page-ID: 3x"), signed=False)
    assert not read(signed.replace(b"Page-ID: 3", b"Page-ID: 4"), signed=False)


def test_a_member_is_not_unpacked_beyond_its_header():
    bomb = warc_salvage._member(archive(False)[1] + b"\0" * (300 << 20))
    started = time.time()
    rows = list(warc_salvage.salvage(warc_salvage.Source(Bytes(bomb + archive(True)[2]))))
    assert [r["page_id"] for _, _, r, _ in rows if r] == [2] and time.time() - started < 5


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(*p, "x", 1, None) for p in PAGES], "page_id long, url string, html string, sha1 string, first int, revisit string")
    rows = warc_salvage.good(warc_salvage.read_archives(warc_salvage.write_archives(pages)))
    assert rows.count() == len(PAGES)


def test_salvage_of_a_damaged_file(spark):
    archives = warc_salvage.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1))
    row = archives.first()
    files, root = open_folder(row.folder)
    with files.open_input_stream(f"{root}/{row.archive}") as f:
        data = f.read()
    folder = scratch_path(spark, "damaged")
    files, root = open_folder(folder)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/x.warc.gz", compression=None) as f:
        f.write(b"noise" + data[:100] + b"\0" * 7 + data)
    found = warc_salvage.read_archives(spark.createDataFrame([(folder, "x.warc.gz")], "folder string, archive string"))
    assert warc_salvage.good(found).count() == row.records
    gaps = warc_salvage.quarantine(found).collect()
    assert [(g.offset, g.length) for g in gaps] == [(0, 112)]


def within(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= most and row[-1]


def test_matcher_against_edit_distance():
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 11))) for _ in range(25)]
    terms = [toxicity.Term(w, False, 1.0) for w in dict.fromkeys(words)] + [toxicity.Term("bcabd", True, 1.0)]
    matcher = toxicity.Matcher(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))
        best = None
        for i, t in enumerate(terms):
            heads = range(len(word) + 1) if t.stem else [len(word)]
            for n in heads:
                edits = within(word[:n], t.text, toxicity.edits_allowed(t.text))
                if edits is not False and (best is None or (edits, i) < best):
                    best = (edits, i)
        assert matcher.match(word) == best, word


def test_quotation_is_told_from_abuse():
    matcher = toxicity.Matcher([toxicity.Term("moron", False, 5.0), toxicity.Term("pathetic", False, 5.0)])
    abuse, quote = toxicity.features("You are a moron, a pathethic moron", matcher), toxicity.features('The word "moron" is an insult; he called it «pathetic»', matcher)
    assert abuse[0] > 0 and abuse[1] == 0 and abuse[2] > 0
    assert quote[0] == 0 and quote[1] > 0
    assert toxicity.features(None, matcher) == toxicity.features("", matcher) == toxicity.features("calm", matcher) == [0.0] * toxicity.N_FEATURES


def test_masked_terms_are_matched():
    matcher = toxicity.Matcher([toxicity.Term("idiot", False, 5.0), toxicity.Term("stupid", False, 4.0)])
    for word in ("id1ot", "idi0t", "id*ot", "(st*pid!)", "st_pid", "st\u00b5pid"):
        found = toxicity.features(f"You {word} there", matcher)
        assert found[2] > 0 and found[0] == found[1] == 0, word
    assert toxicity.features("an idiot-like st1ll don't 1234 mp3", matcher)[2] == 0


def test_long_lines_take_linear_time():
    matcher = toxicity.Matcher([toxicity.Term("idiot", False, 5.0)])
    spent = []
    for n in (30_000, 60_000):
        started = time.time()
        toxicity.features("you 'idiot' id*ot \"are " * n, matcher)
        spent.append(time.time() - started)
    assert spent[1] < 3 * spent[0] + 1


def test_terms_are_not_cut_by_length():
    rated = [(f"term{'x' * (i % 40)}{i}", False, 5, 4.0) for i in range(7000)]
    assert len(toxicity._chosen(rated)) == 7000


def toxic_corpus(spark):
    rng = random.Random(2)
    filler = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ren", "tos", "vul") for c in ("a", "en", "is", "or")]
    bad = ["gronkwit", "blarghead", "snivelton"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(filler) for _ in range(60)]
        toxic = i % 7 == 0
        for _ in range(4 * toxic):
            w = rng.choice(bad)
            if rng.random() < 0.2:
                w = w[:3] + w[4:]
            words[rng.randrange(60)] = w
        rows.append((i, " ".join(words), "en", None, 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, None, None, None), (601, "", None, None, None), (602, None, None, None, None)], "doc_id long, text string, lang string, score string, toxic long")
    return docs, spark.createDataFrame(labels + [(None, None, 1), (3, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.learn(docs, labels)
    assert {"gronkwit", "blarghead", "snivelton"} <= {t.text for t in model.terms} or all(any(w.startswith(t.text) for t in model.terms) for w in ("gronkwit", "blarghead", "snivelton"))
    rows = docs.select("doc_id", toxicity.in_fold(docs["doc_id"]).alias("held"), toxicity.scores(model).alias("s")).collect()
    assert len(rows) == 603 and all(0 <= r.s <= 1 for r in rows)
    held = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 60 and sum((r.s >= 0.5) == (r.doc_id % 7 == 0) for r in held) >= 0.98 * len(held)
    kept = toxicity.passing(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id is null or doc_id > 600").count() == 3


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {r.s for r in docs.select(toxicity.scores(model).alias("s")).collect()} == {0.0}
    assert toxicity.passing(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0


def test_held_out_fold_is_never_learned_from(spark):
    docs, labels = toxic_corpus(spark)
    sample = toxicity.training_sample(docs, labels)
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample.collect()} == {1, 2, 3, 4}
