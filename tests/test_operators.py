"""Ranks, outliers, clusters and skewed groups."""

import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from savora.operators import clustering, grouped, ranks
from savora.operators import terms as counting
from savora.plans import crawl, meals, monitoring

GROUPS = ["a", "b", "c"]


def records(spark, values):
    rows = [(g, i, v) for i, (g, v) in enumerate(values)]
    return spark.createDataFrame(rows, "snapshot string, record_id bigint, stamp bigint")


def drawn(seed, n=400):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "a", "a", "b", "c", "other"]), rng.choice([None, rng.randint(-(10**7), 10**7), rng.randint(0, 9)]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed,hashed", [(1, False), (2, False), (3, True)])
def test_medians(spark, seed, hashed):
    values = drawn(seed)
    if hashed:
        values = [(g, v and v * 0x9E3779B97F4A7C1 % (1 << 62) - (1 << 61)) for g, v in values]
    rows = records(spark, values)
    wanted = {"lo": lambda n: (n + 1) // 2, "hi": lambda n: n // 2 + 1, "first": lambda n: 1, "beyond": lambda n: n + 1}
    found = ranks.keys_at_ranks(rows, "snapshot", "stamp", GROUPS, wanted)
    for g in GROUPS:
        own = [v for k, v in values if k == g and v is not None]
        assert (found[g]["lo"], found[g]["hi"]) == (statistics.median_low(own), statistics.median_high(own))
        assert found[g]["first"] == min(own) and "beyond" not in found[g]


@pytest.mark.parametrize("kind", ["hashed", "tied", "even"])
def test_ranks_count_a_narrow_range_only(spark, monkeypatch, kind):
    """Of 200 000 keys, a few hundred counted ones are shuffled; a sketch that is far off costs a wider pass."""
    value = {"hashed": F.xxhash64("id"), "tied": F.col("id") % 7, "even": F.col("id") * 1000}[kind]
    rows = spark.range(200_000).select(F.lit("a").alias("snapshot"), F.col("id").alias("record_id"), value.alias("stamp"))
    own = sorted(r.stamp for r in rows.collect())
    sizes, counted = [], ranks._counted

    def noted(*args):
        found = counted(*args)
        sizes.append(found.count())
        return found

    monkeypatch.setattr(ranks, "_counted", noted)
    wanted = {"third": lambda n: n // 3, "last": lambda n: n}
    expected = {"a": {"third": own[200_000 // 3 - 1], "last": own[-1]}}
    assert ranks.keys_at_ranks(rows, "snapshot", "stamp", ["a"], wanted) == expected
    assert len(sizes) == 1 and sizes[0] < 4000
    monkeypatch.setattr(ranks, "_sketched", lambda rows: {"a": (200_000, [own[0]] * (ranks.POINTS + 1))})
    assert ranks.keys_at_ranks(rows, "snapshot", "stamp", ["a"], wanted) == expected and len(sizes) > 2


def test_absent_group(spark):
    rows = records(spark, [("a", 5), ("a", 7)])
    assert ranks.doubled_medians(rows, "snapshot", "stamp", GROUPS) == {"a": 12}
    assert ranks.doubled_medians(rows.where("false"), "snapshot", "stamp", GROUPS) == {}


def numpy_filter(values, m=10.0):
    data = np.array(values)
    away = np.abs(data - np.median(data))
    spread = np.median(away)
    return sorted(data[away / spread < m].tolist()) if spread else sorted(values)


@pytest.mark.parametrize("seed", [1, 2])
def test_outliers(spark, seed):
    values = [(g, v) for g, v in drawn(seed)] + [("a", 10**12), ("c", 3)]
    rows = records(spark, values)
    kept = crawl.reject_outliers(rows, "stamp", GROUPS).collect()
    for g in GROUPS:
        own = [v for k, v in values if k == g and v is not None]
        assert sorted(r.stamp for r in kept if r.snapshot == g) == numpy_filter(own)


def test_no_spread_keeps_all(spark):
    rows = records(spark, [("a", 5)] * 9 + [("a", 10**9)])
    assert crawl.reject_outliers(rows, "stamp", ["a"]).count() == 10


def test_sample_and_truncate(spark):
    rows = records(spark, [("a", 1)] * 50 + [("b", 1)] * 7 + [("c", 1)] * 20)
    taken = crawl.sample(rows, GROUPS, 10).groupBy("snapshot").agg(F.count("*").alias("n"), F.max("record_id").alias("m"))
    assert {(r.snapshot, r.n, r.m) for r in taken.collect()} == {("a", 10, 9), ("b", 7, 56), ("c", 10, 66)}
    even = crawl.truncate_to_shortest(rows, GROUPS).groupBy("snapshot").count().collect()
    assert {r["count"] for r in even} == {7} and len(even) == 3


def test_histogram_like_numpy(spark):
    rng = random.Random(8)
    values = [("a", rng.randint(0, 1000)) for _ in range(500)] + [("b", 0), ("b", 1000)]
    found = crawl.histogram(records(spark, values), "stamp", 10)
    counts, _ = np.histogram([v for g, v in values if g == "a"], bins=10, range=(0, 1000))
    assert {r.bin: r.n for r in found.where("snapshot = 'a'").collect()} == {i + 1: c for i, c in enumerate(counts)}
    assert {(r.bin, r.n) for r in found.where("snapshot = 'b' and n > 0").collect()} == {(1, 1), (10, 1)}
    assert found.where("snapshot = 'b'").count() == 10
    flat = crawl.histogram(records(spark, [("a", 5)] * 3), "stamp").where("n > 0").collect()
    assert [(r.bin, r.n) for r in flat] == [(1, 3)]


def test_running_counts_of_hashed_keys_stay_within_partitions(spark):
    counts = spark.range(20_000).select(F.lit("a").alias("g"), F.xxhash64("id").alias("v"), F.lit(1).alias("c"))
    found = ranks.with_running_count(counts, ["g"], ["v"], "c")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("range__" in line for line in plan.split("\n") if "Window [sum(c" in line)
    rows = sorted((r.v, r.upto) for r in found.collect())
    assert [u for _, u in rows] == list(range(1, 20_001))


def test_density_is_close_to_the_exact_curve(spark):
    rng = random.Random(9)
    values = [int(rng.gauss(10**6, 10**4)) for _ in range(400)]
    found = crawl.density(records(spark, [("a", v) for v in values]), "stamp").orderBy("point").collect()
    data, n = np.array(values, dtype=float), len(values)
    width = data.std(ddof=1) * n**-0.2
    xs = np.linspace(data.min(), data.max(), crawl.CURVE_POINTS)
    exact = np.exp(-0.5 * ((xs[:, None] - data) / width) ** 2).sum(axis=1) / (width * np.sqrt(2 * np.pi))
    exact *= (data.max() - data.min()) / 100
    assert np.allclose([r.height for r in found], exact, rtol=0.02, atol=exact.max() * 0.01)


def pairs_of(spark, counts):
    rows = [(b, f"{name} {i}", float(i % 3) / 2, i) for b, n in counts.items() for i in range(n) for name in ("taco",)]
    return spark.createDataFrame(rows, "business_name string, meal_name string, sentiment double, rating int")


def check_clusters(rows, percent=50, **options):
    """All rows are kept, equal names are together, and there are exactly k clusters, numbered from 0."""
    clustered = clustering.cluster_mentions(rows, percent, **options).collect()
    assert len(clustered) == rows.count()
    of_name = {}
    for r in clustered:
        of_name.setdefault((r.business_name, r.meal_name), set()).add(r.cluster)
    assert all(len(found) == 1 for found in of_name.values())
    for business in {b for b, _ in of_name}:
        found = [next(iter(c)) for (b, _), c in of_name.items() if b == business]
        assert sorted(set(found)) == list(range(max(1, len(found) * percent // 100)))
    return {k: next(iter(c)) for k, c in of_name.items()}


def test_clusters_of_any_size(spark):
    rows = pairs_of(spark, {"one": 1, "two": 3, "fifty": 50, "1024": 1024, "1025": 1025}).union(pairs_of(spark, {"two": 3}))
    check_clusters(rows)
    check_clusters(pairs_of(spark, {"a": 90, "b": 7}), run_names=8)
    check_clusters(pairs_of(spark, {"a": 300}), percent=1)


def test_clusters_of_six_thousand_names(spark):
    check_clusters(pairs_of(spark, {"big": 6000}))


def shared(clusters):
    held = {}
    for (_, name), cluster in clusters.items():
        held.setdefault(cluster, []).append(name)
    return {p for names in held.values() for p in itertools.combinations(sorted(names), 2)}


def dishes(n):
    rng = random.Random(n)
    parts = [["grilled", "spicy", "crispy", "smoked", "sweet", "house", "baked", "old"], ["chicken", "beef", "lobster", "tofu", "pork", "bean", "shrimp", "duck"], ["taco", "burrito", "roll", "soup", "salad", "curry", "burger", "bowl"]]
    every = [" ".join(words) for words in itertools.product(*parts)]
    rng.shuffle(every)
    return every


@pytest.mark.parametrize("new", ["aaa", "fish and chips", "zucchini fritters"])
def test_clusters_survive_one_more_name(spark, new):
    names = dishes(1)
    assert len(names) == clustering.RUN_NAMES
    frame = lambda some: spark.createDataFrame([("a", n, 1.0, 5) for n in some], "business_name string, meal_name string, sentiment double, rating int")
    before, after = shared(check_clusters(frame(names))), shared(check_clusters(frame([*names, new])))
    assert len(before & after) >= 0.6 * len(before)


def test_names_with_many_sentiments_stay_whole(spark):
    rows = [("a", name, i / 1500, 1) for name in ("food", "taco") for i in range(1500)]
    found = check_clusters(spark.createDataFrame(rows, "business_name string, meal_name string, sentiment double, rating int"))
    assert set(found.values()) == {0}


def test_names_alone_and_given_vectors(spark):
    rows = [("a", "x", 0.0, [0.0, 1.0]), ("a", "y", 1.0, [0.0, 1.1]), ("a", "z", 0.0, [5.0, 0.0]), ("a", "w", 1.0, [5.1, 0.0]), (None, None, None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "business_name string, meal_name string, sentiment double, v array<double>")
    found = check_clusters(frame, vector="v")
    assert found["a", "x"] == found["a", "y"] != found["a", "z"] == found["a", "w"]
    check_clusters(frame, with_sentiment=False)


def test_clusters_repeat(spark):
    rows = pairs_of(spark, {"a": 120, "b": 20})
    once = {tuple(r) for r in clustering.cluster_mentions(rows, run_names=32).collect()}
    again = {tuple(r) for r in clustering.cluster_mentions(rows.repartition(7), run_names=32).collect()}
    assert once == again


def test_like_names_share_a_cluster(spark):
    meals = ["burrito", "burritos", "lobster roll", "lobster rolls"]
    rows = spark.createDataFrame([("a", m, 1.0, 5) for m in meals], "business_name string, meal_name string, sentiment double, rating int")
    found = {r.meal_name: r.cluster for r in clustering.cluster_mentions(rows).collect()}
    assert found["burrito"] == found["burritos"] != found["lobster roll"] == found["lobster rolls"]


def test_preview_cuts_hot_groups_before_the_shuffle(spark):
    name = F.when(F.col("id") % 9 < 8, "hot").otherwise("cold")
    rows = spark.range(1000).select(name.alias("business_name"), F.col("id").alias("k"))
    top = grouped.first_per_group(rows, ["business_name"], [F.col("k")], 3)
    assert [r.k for r in top.where("business_name = 'hot'").orderBy("k").collect()] == [0, 1, 2]
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


def test_group_stats_join_null_groups(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), (None, 7)], "g string, v int")
    found = grouped.attach_group_stats(rows, ["g"], F.max("v").alias("top")).collect()
    assert sorted((r.v, r.top) for r in found) == [(1, 5), (5, 5), (7, 7)]


def test_feedback_total_sums_daily_distincts(spark):
    votes = spark.createDataFrame(
        [("a", "x", True, "2024-01-01"), ("a", "x", False, "2024-01-02"), ("b", "x", None, "2024-01-02")],
        "business_name string, meal_name string, rec_flag boolean, create_date string",
    ).withColumn("create_date", F.col("create_date").cast("date"))
    total = monitoring.feedback_total(monitoring.feedback_daily(votes)).first()
    assert tuple(total) == (3, 2, 3, 1, 1, 33.3)
    assert tuple(monitoring.feedback_overall(votes).first())[:3] == (2, 1, 3)


def test_many_terms_against_plain_counts(spark):
    rng = random.Random(6)
    terms = ["a", "aa", "aba", "b", "Ba", "cab", "ab", "zz", "é", "AB"]
    rows = [(rng.choice(["s0", "s1", None]), rng.choice([None, "".join(rng.choice("abcABé ") for _ in range(rng.randint(0, 80)))])) for _ in range(300)]
    frame = spark.createDataFrame([*rows, ("empty", "")], "snapshot string, text string")
    found = {(r.snapshot, r.term): r.n for r in terms_of(frame, terms)}
    expected = {(s, t): sum((x or "").lower().count(t.lower()) for g, x in rows if g == s) for s in ("s0", "s1", None) for t in terms}
    assert found == expected | {("empty", t): 0 for t in terms}
    assert terms_of(frame.limit(0), terms) == []
    with pytest.raises(ValueError):
        terms_of(frame, ["a", ""])


def terms_of(frame, wanted):
    return counting.term_totals(frame, "snapshot", F.col("text"), wanted).collect()


def test_correlation_of_many_snapshots(spark):
    rng = np.random.default_rng(5)
    names = [f"s{i}" for i in range(100)]
    matrix = rng.poisson(rng.gamma(0.3, 20, size=(500, 1)), size=(500, 100))
    matrix[:, 7] = 3
    rows = [(names[j], f"d{i}", int(matrix[i, j])) for i in range(500) for j in range(100) if matrix[i, j]]
    counts = spark.createDataFrame(rows + [("other", "x", 5)], "snapshot string, domain string, n long").repartition(7)
    found = {(r.snapshot_a, r.snapshot_b): r["corr"] for r in crawl.snapshot_correlation(counts, names).collect()}
    seen = matrix[matrix.any(axis=1)].astype(float)
    assert len(found) == 10_000
    for i in range(0, 100, 9):
        for j in range(100):
            if 7 in (i, j):
                continue
            assert abs(found[names[i], names[j]] - np.corrcoef(seen[:, i], seen[:, j])[0, 1]) < 1e-9
    assert found["s7", "s8"] is None or len(seen) < 500
    assert crawl.snapshot_correlation(counts.limit(0), names).count() == 0


def test_labels_are_drawn_as_often_as_meals_occur(spark):
    """Over 2000 clusters, a meal with nine of ten mentions is drawn nine times of ten; columns of other names stay."""
    rows = spark.range(20_000).select(
        (F.col("id") % 2000).cast("int").alias("cluster"), F.when(F.col("id") < 18_000, "taco").otherwise("soup").alias("meal_name"), F.lit("x").alias("c"), F.lit("y").alias("b")
    )
    found = meals.with_sample_labels(rows)
    assert found.count() == 20_000 and {(r.c, r.b) for r in found.select("c", "b").distinct().collect()} == {("x", "y")}
    draws = found.select("cluster", "cluster_label").distinct().select(F.explode("cluster_label").alias("m"))
    share = draws.agg(F.avg((F.col("m") == "taco").cast("double"))).first()[0]
    assert draws.count() == 6000 and abs(share - 0.9) < 0.02
    assert meals.sample_labels(rows).collect() != meals.sample_labels(rows, seed=8).collect()


def test_tfidf_clusters_tell_subjects_apart(spark):
    """Texts of three subjects, few words of each in any text: the clusters are the subjects."""
    rng = random.Random(7)
    words = [[f"{s}{i}" for i in range(12)] for s in ("soup", "bike", "tax")]
    texts = [(i, i % 3, " ".join(rng.choices(words[i % 3], k=15) + ["the", "and"])) for i in range(300)]
    found = clustering.tfidf_clusters(spark.createDataFrame(texts, "i int, subject int, t string"), "t").collect()
    assert len({(r.subject, r.cluster) for r in found}) == 3 == len({r.cluster for r in found})


def test_blocks_of_names_are_solved_batch_by_batch(spark):
    """No call per block; blocks that run over batches stay whole, and businesses are kept apart."""
    from savora.operators import clustering

    names = {None: 1, "": 2, "a": 3, "b": 41, "c": 120}
    rows = [(b, None if i == 0 else f"meal {i * 37 % 101} {i}", 0.25) for b, n in names.items() for i in range(n) for _ in range(1 + i % 2)]
    mentions = spark.createDataFrame(rows, "business_name string, meal_name string, sentiment double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {}
    try:
        for batch in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            clustered = clustering.cluster_mentions(mentions)
            assert "FlatMapGroups" not in clustered._jdf.queryExecution().toString()
            found[batch] = sorted(map(str, clustered.collect()))
            numbers = {}
            for r in clustered.collect():
                numbers.setdefault(r.business_name, set()).add(r.cluster)
            assert numbers == {b: set(range(max(1, n // 2))) for b, n in names.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert found["3"] == found["10000"] and len(found["3"]) == len(rows)


def test_embedding_counts_the_grams_of_odd_texts(spark):
    import hashlib

    import numpy as np

    from savora.operators import clustering

    texts = ["", "a", "ab", "abc", "aaaa aaaa", "é\U0001f600xß", None] * 3
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in clustering.embed_text(rows, rows.t, 16).collect():
        if r.t is None:
            assert r.embedding == [None] * 16
            continue
        counts = np.zeros(16)
        for i in range(max(len(r.t) - 2, 1)):
            counts[int(hashlib.md5(r.t[i : i + 3].encode()).hexdigest()[:8], 16) % 16] += 1
        assert r.embedding == (counts / np.sqrt((counts**2).sum())).astype(np.float32).tolist()
    assert "ArrowEvalPython" in clustering.embed_text(rows, rows.t, 16)._jdf.queryExecution().toString()


def test_runs_that_are_no_meals_go_before_the_shuffle(spark):
    from savora.operators import extraction

    reviews = spark.createDataFrame([(1, 3, "red soup and red soup"), (1, 3, "Red soup"), (1, 5, "red soup"), (2, 1, None)], "k int, rating int, text string")
    meals = spark.createDataFrame([("red soup",), ("Red Soup",), ("and",), ("red bean",)], "meal_name string")
    found = extraction.extract_by_dictionary(reviews, meals, "k")
    assert sorted(map(tuple, found.collect())) == [(1, 3, "and", 0.5), (1, 3, "red soup", 0.5), (1, 5, "red soup", 1.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [") < plan.index("Join LeftSemi")


def test_words_are_tested_by_bytes_before_patterns(spark):
    from pyspark.sql import functions as F

    from savora.functions.text import split_words

    text = "Anna's it'S 12 ١٢ 1a _ _1 é9 it's' x'sy 's 7's ß O'Neil's"
    cut = spark.createDataFrame([(text,), (None,)], "t string").select(split_words(F.col("t")).alias("w"))
    assert [r.w for r in cut.collect()] == [["Anna", "it", "1a", "_", "_1", "é9", "it's'", "x'sy", "s", "ß", "O'Neil"], None]
    assert "regexp_replace" not in cut._jdf.queryExecution().optimizedPlan().toString()
