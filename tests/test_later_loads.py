"""Clusters over several loads, and JSON arrays read in ranges."""

import json
import random

import numpy as np
import pytest

from savora.operators import stored_clusters
from savora.plans import meals
from savora.session import scratch_path
from savora.sources import json_arrays, tables

DDL = "business_name string, rating int, meal_name string, sentiment double"


@pytest.fixture
def store(spark):
    found = tables.TableStore(spark, scratch_path(spark, "store"))
    found.create_empty(["mart.meal_mentions", "mart.meal_centres"])
    return found


def load(rng, names, n):
    return [(rng.choice(["Anna's", "Bob's", None]), rng.randint(1, 5), rng.choice(names), 0.5) for _ in range(n)]


def test_earlier_clusters_keep_number_and_label(spark, store):
    rng = random.Random(2)
    names = [a + " " + b for a in ("beef", "fish", "bean", "corn", "veal") for b in ("taco", "soup", "salad", "burrito")] + ["", None]
    more = names + [n + "s" for n in names if n] + ["zzyzx quark", "blorptastic", "grommet flan"]
    every, last = [], {}
    for number, pool in enumerate([names[:12], names, more, more]):
        rows = load(rng, pool, 150)
        every += rows
        meals.add_load(store, spark.createDataFrame(rows, DDL), f"load-{number}")
        found = store.read("mart.meal_mentions").collect()
        assert sorted(map(str, ((r.business_name, r.rating, r.meal_name, r.sentiment) for r in found))) == sorted(map(str, (r for r in every if r[2] is not None)))
        now = {}
        for r in found:
            assert now.setdefault((r.business_name, r.meal_name), (r.cluster, r.cluster_label)) == (r.cluster, r.cluster_label)
        assert now.items() >= last.items()
        last = now
        labels = {}
        for (business, _), (cluster, label) in now.items():
            assert labels.setdefault((business, cluster), label) == label
        centres = store.read("mart.meal_centres").collect()
        assert len({(c.business_name, c.cluster) for c in centres}) == len(centres) and {(c.business_name, c.cluster) for c in centres} >= set(labels)
    before = sorted(map(str, store.read("mart.meal_mentions").collect()))
    meals.add_load(store, spark.createDataFrame(rows, DDL), "load-3")
    assert sorted(map(str, store.read("mart.meal_mentions").collect())) == before
    own = last["Anna's", "zzyzx quark"][0], last["Anna's", "blorptastic"][0]
    assert min(own) > max(c for (b, m), (c, _) in last.items() if b == "Anna's" and m in names[:12])


def test_nearest_centre_is_the_nearest_within_reach(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    vectors = centres[rng.integers(0, 40, 200)] + rng.normal(size=(200, 64)) * rng.choice([0.1, 3.0], size=(200, 1))
    held = spark.createDataFrame([("b", i, f"l{i}", c.tolist()) for i, c in enumerate(centres)], "business_name string, cluster int, cluster_label string, centre array<float>")
    names = spark.createDataFrame([("b", f"n{i}", v.tolist()) for i, v in enumerate(vectors)] + [("other", "x", centres[0].tolist())], "business_name string, meal_name string, embedding array<float>")
    found = {r.meal_name: (r.cluster, r.cluster_label) for r in stored_clusters.nearest_centres(names, held).collect()}
    cosine = (vectors / np.linalg.norm(vectors, axis=1)[:, None]) @ (centres / np.linalg.norm(centres, axis=1)[:, None]).T
    expected = {f"n{i}": (int(row.argmax()), f"l{row.argmax()}") for i, row in enumerate(cosine) if row.max() >= stored_clusters.REACH}
    assert found == expected and 50 < len(found) < 200


PIECES = ["a", "]", "[", "{", "}", ",", '"', "\\", "\\\\", '\\"', "é😀", "\n", " ", ":", " "]


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_json_arrays_in_ranges(spark, range_bytes):
    rng = random.Random(range_bytes)
    folder = scratch_path(spark, "json")
    files, root = json_arrays._opened(folder)
    files.create_dir(root)
    expected = []
    for name, n in (("a", 12), ("b", 0), ("c", 1), ("d", 5)):
        rows = [{"i": i, "t": "".join(rng.choices(PIECES, k=rng.randint(0, 6))), "l": [{"k": rng.choice(PIECES)} for _ in range(rng.randint(0, 2))]} for i in range(n)]
        expected += rows
        text = json.dumps(rows, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        with files.open_output_stream(f"{root}/{name}.json") as out:
            out.write((rng.choice(["", " \n"]) + text + rng.choice(["", "\n"])).encode())
    with files.open_output_stream(f"{root}/empty.json"):
        pass
    schema = "i int, t string, l array<struct<k string>>"
    found = [{"i": r.i, "t": r.t, "l": [{"k": x.k} for x in r.l]} for r in json_arrays.read_json_array(spark, folder, schema, range_bytes).collect()]
    order = lambda r: (r["i"], r["t"], str(r["l"]))
    assert sorted(found, key=order) == sorted(expected, key=order)
    assert json_arrays.read_json_array(spark, f"{folder}/c.json", schema, range_bytes).count() == 1


def test_small_ranges_share_tasks(spark, tmp_path):
    rows = [{"a": i, "b": "x" * (i % 40) + '["\\'} for i in range(3000)]
    path = tmp_path / "many.json"
    path.write_text(json.dumps(rows))
    read = json_arrays.read_json_array(spark, str(path), "a bigint, b string", 64)
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted((r.a, r.b) for r in read.collect()) == [(r["a"], r["b"]) for r in rows]


def test_names_meet_centres_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(stored_clusters, "TILE", 5)
    rng = np.random.default_rng(4)
    vectors, centres = (rng.integers(0, 3, (n, 6)).astype(np.float32) for n in (60, 30))
    centres[7] = centres[3]
    businesses = ["Anna's", None, ""]
    names = [(businesses[i % 3], None if i == 4 else f"n{i}", v.tolist()) for i, v in enumerate(vectors)] + [("Anna's", "short", [1.0, 1.0])]
    held = [(businesses[j % 2], j, f"l{j}", v.tolist()) for j, v in enumerate(centres)] + [("Anna's", 99, "none", None)]
    named = spark.createDataFrame(names, "business_name string, meal_name string, embedding array<float>")
    stored = spark.createDataFrame(held, "business_name string, cluster int, cluster_label string, centre array<float>")
    near = stored_clusters.nearest_centres(named, stored, 0.8)
    assert "FlatMapCoGroups" in near._jdf.queryExecution().toString()
    found = {(r.business_name, r.meal_name): (r.cluster, r.cluster_label) for r in near.collect()}
    wanted = {}
    for business, name, v in names:
        v, best = np.array(v, float), (0.0, 0, None)
        for other, number, label, c in held:
            if other == business and c is not None and len(c) == len(v) and np.any(v) and np.any(c):
                cosine = v @ np.array(c) / (np.sqrt(v @ v) * np.sqrt(np.dot(c, c)))
                best = max(best, (round(cosine, 9), -number, label))
        if best[0] >= 0.8:
            wanted[business, name] = (-best[1], best[2])
    assert found == wanted and len(wanted) > 5
