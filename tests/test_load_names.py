"""A load's work is done by name: what is made once, solved together, and kept apart."""

import random

import numpy as np
import pytest

from savora.operators import clustering, stored_clusters
from savora.plans import meals
from savora.session import scratch_path
from savora.sources import tables

DDL = "business_name string, rating int, meal_name string, sentiment double"
NAMES = [a + " " + b for a in ("beef", "fish", "bean", "corn") for b in ("taco", "soup", "salad")]


@pytest.fixture
def store(spark):
    found = tables.TableStore(spark, scratch_path(spark, "store"))
    found.create_empty(["mart.meal_mentions", "mart.meal_centres"])
    return found


def test_small_tiles_share_calls(spark, monkeypatch):
    """The names and centres of many businesses meet in one call, not in a call each."""
    made = stored_clusters._met

    def counted(reach):
        run = made(reach)

        def told(names, centres):
            import uuid

            import pyarrow as pa

            found = run(names, centres)
            call = pa.table([["call"], [uuid.uuid4().hex], [1.0], [0], ["call"]], names=found.column_names).cast(found.schema)
            return pa.concat_tables([found, call])

        return told

    monkeypatch.setattr(stored_clusters, "_met", counted)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(120, 8)).astype(np.float32)
    centres = spark.createDataFrame([(f"b{i % 40}", i, f"l{i}", v.tolist()) for i, v in enumerate(vectors)], "business_name string, cluster int, cluster_label string, centre array<float>")
    names = spark.createDataFrame([(f"b{i % 40}", f"n{i}", v.tolist()) for i, v in enumerate(vectors)], "business_name string, meal_name string, embedding array<float>")
    found = stored_clusters.nearest_centres(names, centres, 0.99).collect()
    assert sum(r.business_name == "call" for r in found) == 1
    assert {(r.meal_name, r.cluster, r.cluster_label) for r in found if r.business_name != "call"} == {(f"n{i}", i, f"l{i}") for i in range(120)}


def test_a_name_gets_its_vector_once_a_load(spark, store, monkeypatch, tmp_path):
    made, log = clustering._text_vectors, str(tmp_path / "texts")

    def logged(texts, size):
        with open(log, "a") as out:
            out.writelines(f"{t}\n" for t in texts.to_pylist())
        return made(texts, size)

    monkeypatch.setattr(clustering, "_text_vectors", logged)
    rows = [(b, i % 5 + 1, n, 0.25) for b in ("a", "b", None) for i, n in enumerate(NAMES * 3)]
    meals.add_load(store, spark.createDataFrame(rows[:90], DDL), "load-1")
    meals.add_load(store, spark.createDataFrame(rows + [("a", 1, "squid rings", 0.5)], DDL), "load-2")
    with open(log) as told:
        texts = sorted(told.read().splitlines())
    assert texts == sorted([f"['{n}', 0.25]" for n in NAMES] * 3 + ["['squid rings', 0.5]"])


def test_centres_are_the_means_of_their_names(spark, store):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "", None]), 1, rng.choice([*NAMES, "", None]), rng.choice([0.0, 0.3, None])) for _ in range(200)]
    found = meals.add_load(store, spark.createDataFrame(rows, DDL), "load-1").collect()
    of = {}
    for r in found:
        of.setdefault((r.business_name, r.cluster, r.cluster_label), {}).setdefault(r.meal_name, []).append(0.5 if r.sentiment is None else r.sentiment)
    wanted = {}
    for key, names in of.items():
        texts = [f"['{n}', {round(sum(s) / len(s), 10)}]" for n, s in names.items()]
        some = spark.createDataFrame([(t,) for t in texts], "t string")
        vectors = np.array([r.embedding for r in clustering.embed_text(some.coalesce(1), some.t).collect()])
        wanted[key] = np.average(vectors, axis=0, weights=[len(s) for s in names.values()])
        assert key[2] == min(names, key=lambda n: (-len(names[n]), n))
    centres = {(c.business_name, c.cluster, c.cluster_label): np.array(c.centre) for c in store.read("mart.meal_centres").collect()}
    assert centres.keys() == wanted.keys() and len(centres) > 10
    assert all((centres[k] == wanted[k].astype(np.float32)).all() for k in wanted)


def test_clusters_without_a_centre_get_one(spark, store):
    """Mentions that were stored without centres keep their clusters; a load that has them opens the centres."""
    old = [("a", 5, "beef taco", 0.5, 0, "beef taco"), ("a", 5, "corn soup", 0.5, 1, "corn soup"), ("a", 5, "x", 0.5, None, None)]
    store.append("mart.meal_mentions", spark.createDataFrame(old, f"{DDL}, cluster int, cluster_label string"), "load-0")
    found = meals.add_load(store, spark.createDataFrame([("a", 1, "beef taco", 0.5), ("a", 1, None, 0.5), (None, 2, "beef taco", 0.5)], DDL), "load-1")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", 1, "beef taco", 0.5, 0, "beef taco"), (None, 2, "beef taco", 0.5, 0, "beef taco")]))
    centres = {(c.business_name, c.cluster, c.cluster_label) for c in store.read("mart.meal_centres").collect()}
    assert centres == {("a", 0, "beef taco"), (None, 0, "beef taco")}


def test_blocks_of_one_size_are_solved_together():
    rng = np.random.default_rng(7)
    for n, k in ((1, 1), (2, 1), (7, 3), (12, 6), (30, 30)):
        points = rng.integers(0, 3, (25, n, 5)).astype(float)
        points[0] = points[0, :1]
        weights = rng.integers(1, 4, (25, n)).astype(float)
        together = clustering._weighted_kmeans(points, weights, k, 25)
        alone = [clustering._weighted_kmeans(points[i : i + 1], weights[i : i + 1], k, 25)[0] for i in range(25)]
        assert (together == np.stack(alone)).all() and all(len(set(row)) == k for row in together.tolist())
