"""Prompts, answers, mentions and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.catalog.registry import query, rounded, sql_list
from savora.catalog.reviews import STAGED, staged
from savora.functions import response
from savora.functions.text import strip_stopwords
from savora.operators import clustering, extraction
from savora.plans import marts, meals, staging
from savora.session import scratch_path, stored
from savora.sources.tables import TableStore

WORDS = ["blue", "red", "old", "new"]

PAIRS = """
    parsed as (
        select review_id, case when contains(response, 'No Meals in Review') then 'no_meals'
               when response like '[%' then 'ok' else 'bad_format' end status, response from {v_responses}),
    items as (
        select review_id, status, unnest(case when status = 'ok'
               then cast(json_extract(response, '$[*]') as varchar[]) else [cast(null as varchar)] end) item
        from parsed)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "build_prompts",
    f"""select doc_id, {_quoted(response.PROMPT_HEAD)} || coalesce(text, 'None')
               || {_quoted(response.PROMPT_TAIL)} prompt from {{documents}}""",
)
def build_prompts(t):
    return t("documents").select("doc_id", response.build_prompt(F.col("text")).alias("prompt"))


@query(
    "parse_response",
    f"""with {PAIRS} select review_id, status, case when status = 'ok'
               then cast(len(json_extract(response, '$[*]')) as int) end items from parsed""",
)
def parse_response(t):
    return response.parse_response(t("v_responses")).select(
        "review_id", "status", F.when(F.col("items").isNotNull(), F.size("items")).alias("items")
    )


@query(
    "explode_meals",
    f"""with {PAIRS} select review_id, status,
               case when item is null then '' else json_extract_string(item, '$[0]') end meal_name,
               case when item is null then 0.5 else cast(json_extract_string(item, '$[1]') as double) end sentiment
        from items""",
)
def explode_meals(t):
    parsed = response.parse_response(t("v_responses")).drop("response")
    return response.explode_meals(parsed)


@query(
    "strip_stopwords",
    f"""select p_partkey, array_to_string(list_filter(string_split(p_name, ' '),
               lambda w: lower(w) not in ({sql_list(WORDS)})), ' ') meal_name from {{part}}""",
)
def strip_words(t):
    return t("part").select("p_partkey", strip_stopwords(F.col("p_name"), WORDS).alias("meal_name"))


def _documents_as_reviews(t):
    return t("documents").select(
        "doc_id", (1 + F.col("n_chars") % 5).cast("int").alias("rating"), F.col("text").alias("review_text")
    )


# Every word of the benchmark, every run of three of its words, and every part name is a meal here.
DICTIONARY = """
    bench as (
        select list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}'']+', ' ', 'g'), ' '), lambda x: x <> '') ws
        from {benchmark} where text is not null),
    dictionary as (
        select unnest(ws) meal_name from bench
        union select unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) from bench
        union select distinct p_name from {part})"""
CUT = """
    cut as (select doc_id, cast(1 + n_chars % 5 as int) rating,
                   list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}'']+', ' ', 'g'), ' '),
                               lambda x: x <> '') ws from {documents} where text is not null),
    runs as (
        select doc_id, rating, unnest(list_distinct(list_concat(ws,
               list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
               list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) meal_name from cut)"""


def _dictionary(t):
    words = t("benchmark").where("text is not null").select(extraction.words_of(F.col("text")).alias("ws"))
    three = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("ws") - 2, F.lit(1))), lambda i: F.array_join(F.slice("ws", i, 3), " ")
    )
    runs = words.where(F.size("ws") > 2).select(F.explode(three).alias("meal_name"))
    return words.select(F.explode("ws").alias("meal_name")).union(runs).union(t("v_dictionary"))


@query(
    "extract_lexicon",
    f"""with {DICTIONARY}, {CUT}
        select doc_id, rating, r.meal_name, (rating - 1) / 4.0 sentiment
        from runs r join dictionary d on r.meal_name = d.meal_name""",
)
def extract_lexicon(t):
    return extraction.extract_by_dictionary(_documents_as_reviews(t), _dictionary(t), "doc_id", "review_text")


@query(
    "embed_meals",
    """with texts as (
           select distinct '[''' || lower(meal_name) || ''', ' || cast(sentiment as varchar) || ']' t from {v_mentions}),
       grams as (
           select t, cast('0x' || substr(md5(g), 1, 8) as bigint) % 64 place
           from (select t, unnest(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substr(t, i, 3))) g from texts)),
       counts as (select t, place, count(*) n from grams group by 1, 2)
       select t, cast(place as int) place, round(n / sqrt(sum(n * n) over (partition by t)), 5) value from counts""",
)
def embed_meals(t):
    text = clustering.mention_text(F.col("meal_name"), F.col("sentiment"))
    texts = t("v_mentions").select(text.alias("t")).distinct()
    # Not plain posexplode: the filter Spark derives from it would be pushed below the distinct and embed every row.
    long = clustering.embed_text(texts, F.col("t")).select("t", F.posexplode_outer("embedding").alias("place", "value"))
    return rounded(long.where("value > 0").withColumn("value", F.col("value").cast("double")), 5, "value")


def _clustered(t):
    return clustering.cluster_mentions(t("v_mentions").drop("cluster", "cluster_label"))


@query(
    "cluster_meals",
    """select business_name, meal_name, count(*) mentions, 1::bigint clusters, true in_range
       from {v_mentions} group by 1, 2""",
)
def cluster_meals(t):
    """Every mention is kept, equal names share a cluster, and numbers stay below k."""
    names = t("v_mentions").groupBy("business_name").agg(F.count_distinct("meal_name").alias("names"))
    inside = (F.min("cluster") >= 0) & (F.max("cluster") < F.greatest(F.lit(1), F.floor(F.first("names") / 2)))
    return (
        _clustered(t).join(names, "business_name")
        .groupBy("business_name", "meal_name")
        .agg(F.count("*").alias("mentions"), F.count_distinct("cluster").alias("clusters"), inside.alias("in_range"))
    )


@query(
    "cluster_sizes",
    """select business_name, count(*) mentions, count(distinct meal_name) meals,
              cast(greatest(1, count(distinct meal_name) // 2) as bigint) clusters
       from {v_mentions} group by 1""",
)
def cluster_sizes(t):
    return _clustered(t).groupBy("business_name").agg(
        F.count("*").alias("mentions"),
        F.count_distinct("meal_name").alias("meals"),
        F.count_distinct("cluster").alias("clusters"),
    )


@query(
    "cluster_words",
    f"""with {DICTIONARY}, words as (select distinct meal_name from dictionary)
        select count(*) meals, cast(greatest(1, count(*) // 2) as bigint) clusters, 1::bigint most_of_a_name from words""",
)
def cluster_words(t):
    """One business with thousands of names, clustered by name alone."""
    mentions = _dictionary(t).withColumn("business_name", F.lit("all")).withColumn("sentiment", F.lit(None).cast("double"))
    found = clustering.cluster_mentions(mentions, with_sentiment=False)
    per_name = found.groupBy("meal_name").agg(F.count_distinct("cluster").alias("c"), F.min("cluster").alias("cluster"))
    return per_name.agg(F.count("*").alias("meals"), F.count_distinct("cluster").alias("clusters"), F.max("c").alias("most_of_a_name"))


def _squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


@query("kmeans_embeddings", "select vec_id, label, true own_is_nearest from {embeddings}")
def kmeans_embeddings(t):
    """No other cluster's mean is nearer to a vector than that of its own cluster."""
    k = 10
    found = stored(
        clustering.kmeans_vectors(t("embeddings"), "embedding", k=k).select(
            "vec_id", "label", "cluster", F.transform("embedding", lambda x: x.cast("double")).alias("v")
        ),
        "kmeans",
    )
    means = (
        found.select("cluster", F.posexplode("v").alias("i", "x"))
        .groupBy("cluster", "i").agg(F.avg("x").alias("x"))
        .groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean"))
        .agg(F.map_from_entries(F.collect_list(F.struct("cluster", "mean"))).alias("means"))
    )
    # One row of k means.
    placed = found.join(F.broadcast(means))
    away = F.transform_values("means", lambda _, mean: _squared_distance(F.col("v"), mean))
    return placed.withColumn("away", away).select(
        "vec_id", "label", (F.element_at("away", F.col("cluster")) <= F.array_min(F.map_values("away")) + 1e-9).alias("own_is_nearest")
    )


@query(
    "tfidf_kmeans",
    """select text, count(*) copies, 1::bigint clusters, true in_range from {documents} group by 1""",
)
def tfidf_kmeans(t):
    """Equal texts share one of the three clusters."""
    docs = t("documents").select("doc_id", "text")
    found = clustering.tfidf_clusters(docs, "text").select("doc_id", "cluster")
    return docs.join(found, "doc_id").groupBy("text").agg(
        F.count("*").alias("copies"),
        F.count_distinct("cluster").alias("clusters"),
        F.min(F.col("cluster").between(0, 2)).alias("in_range"),
    )


NEW = f"""{STAGED}, {DICTIONARY},
    fresh as (select row_number() over () id, business_name, rating, review_text from staged
              where business_name not in (select business_name from {{v_processed}})),
    cut as (select id, business_name, rating,
                   list_filter(string_split(regexp_replace(review_text, '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'), ' '), lambda x: x <> '') ws
            from fresh),
    runs as (
        select id, business_name, rating, unnest(list_distinct(list_concat(ws,
               list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
               list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])))) meal_name from cut),
    mentions as (select business_name, rating, r.meal_name, (rating - 1) / 4.0 sentiment
                 from runs r join dictionary d on r.meal_name = d.meal_name)""".replace("{{", "{").replace("}}", "}")


def _extract(t):
    dictionary = _dictionary(t)
    return lambda reviews: meals.known_mentions(reviews, dictionary)


@query(
    "new_business_meals",
    f"""with {NEW} select business_name, rating, meal_name, sentiment, count(*) mentions, true labelled from mentions group by 1, 2, 3, 4""",
)
def new_business_meals(t):
    """All mentions are kept, and each label is a meal of the same business."""
    found = stored(meals.meal_mentions(staging.new_reviews(staged(t), t("v_processed")), _extract(t)), "new-meals")
    known = found.select(F.col("business_name").alias("b"), F.col("meal_name").alias("m")).distinct().withColumn("known", F.lit(True))
    rows = found.join(known, (F.col("business_name") == F.col("b")) & (F.col("cluster_label") == F.col("m")), "left")
    return rows.groupBy("business_name", "rating", "meal_name", "sentiment").agg(
        F.count("*").alias("mentions"), F.min(F.coalesce("known", F.lit(False))).alias("labelled")
    )


@query(
    "later_load",
    """select business_name, count(*) mentions, count(distinct meal_name) meals, true kept, true one_label, true numbered
       from {v_mentions} where meal_name is not null group by 1""",
)
def later_load(t):
    """Two loads: the second brings new names and repeats old ones, whose clusters keep number and label."""
    store = TableStore(t.spark, scratch_path(t.spark, "store"))
    store.create_empty(["mart.meal_mentions", "mart.meal_centres"])
    # Written, as each load reads its part twice.
    mentions = stored(t("v_mentions").select("business_name", "rating", "meal_name", "sentiment"), "mentions")
    later = F.pmod(F.xxhash64("meal_name"), F.lit(4)) == 0
    # Of the names of the first load, some mentions come with the second.
    first = ~later & (F.col("sentiment") < 0.5)
    named = ["business_name", "meal_name"]
    # Mentions that are alike in all that is asked are counted first. The hash decides most comparisons of a sort.
    hashed = F.xxhash64(*named).alias("hash")
    before = meals.add_load(store, mentions.where(first), "load-1").select(hashed, *named, "cluster", "cluster_label").distinct()
    before = before.groupBy("hash", *named).agg(F.first("cluster").alias("old"), F.first("cluster_label").alias("old_label"))
    meals.add_load(store, mentions.where(~first), "load-2")
    rows = store.read("mart.meal_mentions").where("business_name is not null and cluster is not null")
    rows = stored(rows.groupBy(hashed, *named, "cluster", "cluster_label").agg(F.count("*").alias("n")), "counted-mentions")
    labels = rows.groupBy("business_name", "cluster").agg(F.count_distinct("cluster_label").alias("labels"), F.min("cluster").alias("lowest"))
    labels = labels.groupBy("business_name").agg(F.bool_and(F.col("labels") <= 1).alias("one_label"), F.bool_and(F.col("lowest") >= 0).alias("numbered"))
    kept = F.col("old").isNull() | ((F.col("old") == F.col("cluster")) & F.col("old_label").eqNullSafe(F.col("cluster_label")))
    facts = rows.join(before, ["hash", *named], "left").groupBy("hash", *named).agg(F.sum("n").alias("n"), F.bool_and(kept).alias("kept"))
    facts = facts.groupBy("business_name").agg(
        F.sum("n").alias("mentions"), F.count("meal_name").alias("meals"), F.bool_and("kept").alias("kept")
    )
    return facts.join(labels, "business_name")


@query(
    "new_business_counts",
    f"""with {NEW} select business_name, meal_name, count(*) mentions, sum(rating)::bigint ratings from mentions group by 1, 2""",
)
def new_business_counts(t):
    todo = staging.new_reviews(staged(t), t("v_processed"))
    return _extract(t)(todo).groupBy("business_name", "meal_name").agg(
        F.count("*").alias("mentions"), F.sum("rating").alias("ratings")
    )


@query(
    "new_business_recs",
    f"""with {NEW} select business_name, count(*)::bigint total_reviews, round(avg(rating), 6) avg_rating from mentions group by 1""",
)
def new_business_recs(t):
    """Processed to the end: the load is appended, read back and recommended; no mention gets lost on the way."""
    store = TableStore(t.spark, scratch_path(t.spark, "store"))
    store.create_empty(["mart.meal_mentions", "mart.feedback"])
    todo = staging.new_reviews(staged(t), t("v_processed"))
    whole = meals.process_new(store, todo, _extract(t), "load-1")
    recs = marts.recommendations(whole, store.read("mart.feedback"))
    weighed = F.sum(F.col("avg_review_rating") * F.col("total_reviews")) / F.sum("total_reviews")
    return rounded(
        recs.groupBy("business_name").agg(F.sum("total_reviews").alias("total_reviews"), weighed.alias("avg_rating")), 6, "avg_rating"
    )
