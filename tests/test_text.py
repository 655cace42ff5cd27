"""Answers, phrases, words and addresses."""

import collections
import math
import random
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from savora.functions import response, text
from savora.operators import extraction
from savora.plans import dashboard

CASES = {
    '[["taco", 0.8], ["soup", 1]]': [("ok", "taco", 0.8), ("ok", "soup", 1.0)],
    "[['Anna\\'s taco', 0.5]]": [("ok", "Anna's taco", 0.5)],
    '[["a", 0.5], "c"]': [("ok", "a", 0.5), ("ok", "", 0.5)],
    '[["a", 0.5, 1], ["b"]]': [("ok", "", 0.5), ("ok", "", 0.5)],
    "[]": [("ok", "", 0.5)],
    "No Meals in Review": [("no_meals", "", 0.5)],
    '[["No Meals in Review", 0]]': [("no_meals", "", 0.5)],
    "nothing to see": [("bad_format", "", 0.5)],
    "[broken": [("bad_format", "", 0.5)],
    None: [("bad_format", "", 0.5)],
}


@pytest.mark.parametrize("answer", list(CASES))
def test_answers(spark, answer):
    rows = spark.createDataFrame([(answer,)], "response string")
    found = response.explode_meals(response.parse_response(rows)).collect()
    assert [(r.status, r.meal_name, r.sentiment) for r in found] == CASES[answer]


def test_url_authority_like_the_standard_library(spark):
    urls = [
        "http://u:p@h.com:80/x?y#z", "https://a.b", "//c.d/e", "no scheme", "mailto:x@y.z", "ftp://f?q", "",
        "http:///path", "HTTP://UP.com/x",
    ]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    found = [r[0] for r in rows.select(text.url_authority(F.col("u"))).collect()]
    assert found == [urlparse(u).netloc for u in urls]


def test_occurrences(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aAb/") for _ in range(40)) for _ in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for term in ("aa", "A/b", "b"):
        found = [r[0] for r in rows.select(text.occurrences(F.col("t"), term)).collect()]
        assert found == [t.lower().count(term.lower()) for t in texts]


def test_sql_function(spark):
    text.register_sql_functions(spark)
    assert spark.sql("select lower(clean_special_characters('Hé, You!')) x").first().x == "h you"


def test_strip_stopwords(spark):
    rows = spark.createDataFrame([("The spicy taco of the day",)], "m string")
    assert rows.select(text.strip_stopwords(F.col("m"), ["the", "of"])).first()[0] == "spicy taco day"


def test_dictionary_against_brute_force(spark):
    rng = random.Random(5)
    words = ["taco", "soup", "hot", "dog", "blue", "cheese"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))).title() + "!" for _ in range(60)]
    meals = ["hot dog", "taco", "blue cheese soup"]
    reviews = spark.createDataFrame([(i, 1 + i % 5, t) for i, t in enumerate(texts)], "id int, rating int, text string")
    dictionary = spark.createDataFrame([(m,) for m in meals], "meal_name string")
    found = extraction.extract_by_dictionary(reviews, dictionary, "id").collect()
    expected = {(i, m) for i, t in enumerate(texts) for m in meals if f" {m} " in f" {t.lower().rstrip('!')} "}
    assert {(r.id, r.meal_name) for r in found} == expected and len(found) == len(expected)


def test_word_counts(spark):
    texts = ["The taco's tacos, Tacos 42 été", None, "class classes été I've it's b"]
    rows = spark.createDataFrame([(t,) for t in texts], "review_text string")
    found = {r.word: r.n for r in dashboard.word_counts(rows).collect()}
    assert found == {"taco": 1, "tacos": 2, "été": 2, "class": 1, "classes": 1, "b": 1}
    merged = {r.word: r.n for r in dashboard.word_counts(rows, merge_plurals=True).collect()}
    assert merged == {"taco": 3, "été": 2, "class": 1, "classes": 1, "b": 1}


def brute_force_cloud(texts, threshold):
    words = [[re.sub("'[sS]$", "", w) for w in re.findall(r"\w[\w']*", t)] for t in texts]
    words = [[w for w in ws if not w.isdigit()] for ws in words]
    stop = set(text.CLOUD_STOPWORDS)

    def merged(counts):
        low = collections.Counter()
        for w, n in counts.items():
            low[w.lower()] += n
        home = {w: w[:-1] if w.endswith("s") and not w.endswith("ss") and w[:-1] in low else w for w in low}
        total = collections.Counter()
        for w, n in low.items():
            total[home[w]] += n
        return total, home

    singles = collections.Counter(w for ws in words for w in ws if w.lower() not in stop)
    pairs = collections.Counter(
        f"{a} {b}" for ws in words for a, b in zip(ws, ws[1:]) if not {a.lower(), b.lower()} & stop
    )
    terms, home = merged(singles)
    total, cloud = sum(singles.values()), dict(terms)

    def likelihood(k, n, x):
        return math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (n - k)

    for pair, k in merged(pairs)[0].items():
        a, b = (home[w] for w in pair.split(" "))
        m, n = terms[a], terms[b]
        score = -2 * (
            likelihood(k, m, n / total) + likelihood(n - k, total - m, n / total)
            - likelihood(k, m, k / m) - likelihood(n - k, total - m, (n - k) / (total - m))
        )
        if score > threshold:
            cloud[a] -= k
            cloud[b] -= k
            cloud[pair] = k
    return {w: n for w, n in cloud.items() if n > 0}


def test_cloud_against_brute_force(spark):
    rng = random.Random(11)
    pool = ["Hot dog", "hot dogs", "lobster roll", "Lobster rolls", "taco", "Tacos", "the", "class", "grass", "of 7", "chef's"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "review_text string")
    found = {r.word.lower(): r.n for r in dashboard.cloud_terms(rows, top=1000).collect()}
    expected = brute_force_cloud(texts, 30.0)
    assert found == expected
    assert any(" " in w for w in found)


def test_cloud_without_words(spark):
    rows = spark.createDataFrame([(None,)], "review_text string")
    assert dashboard.cloud_terms(rows).count() == 0
