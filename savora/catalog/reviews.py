"""Staging, marts and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.catalog.registry import Tables, query, rounded, sql_list
from savora.catalog.views import DENIED_PART, DENIED_WORDS
from savora.functions.text import clean_text, register_sql_functions, undouble_quotes
from savora.operators.grouped import value_counts
from savora.plans import marts, meals, recommend, staging
from savora.session import scratch_path, stored
from savora.sources.tables import TableStore, dated

RULES = {"words": DENIED_WORDS, "part": DENIED_PART}

STAGED = """
    staged as (
        select distinct b.gmap_id, b.name business_name, b.address, split_part(b.address, ',', -2) city,
               r.user_id, r.rating, regexp_replace(lower(r.text), '[^a-z0-9 ]', '', 'g') review_text
        from {v_business} b left join {v_reviews} r on b.gmap_id = r.gmap_id
        where contains(b.category, 'restaurant') and r.text is not null)"""

RECS = """
    meals as (
        select business_name, cluster_label meal_name, count(*) total_reviews,
               avg(rating) avg_review_rating,
               avg(cast(regexp_replace(cast(sentiment as varchar), '[^0-9.]', '', 'g') as double)) avg_meal_sentiment
        from {v_mentions} where cluster_label <> '' group by 1, 2),
    votes as (
        select business_name, meal_name,
               cast(sum(case when rec_flag then 1 else 0 end) as bigint) total_pos_feedback,
               cast(sum(case when rec_flag = false then 1 else 0 end) as bigint) total_neg_feedback
        from {v_feedback} group by 1, 2),
    recs as (
        select a.*, total_pos_feedback, total_neg_feedback
        from meals a left join votes b on a.business_name = b.business_name and a.meal_name = b.meal_name)"""

SCORED = RECS + """,
    based as (
        select *, (total_reviews / nullif(max(total_reviews) over w, 0) * 0.6
                   + avg_review_rating / nullif(max(avg_review_rating) over w, 0) * 0.3
                   + avg_meal_sentiment / nullif(max(avg_meal_sentiment) over w, 0) * 0.1) * 100 base
        from recs window w as (partition by business_name)),
    scored as (
        select * exclude (base),
               case when total_pos_feedback is not null
                    then least(100.0, base * (1 + total_pos_feedback * 0.1 - total_neg_feedback * 0.1))
                    else base end recommendation_score
        from based)"""

MENU = f"""lower(meal_name) not in ({sql_list(DENIED_WORDS)}) and total_reviews >= 2
           and not contains(lower(meal_name), '{DENIED_PART}')"""


def staged(t: Tables):
    return staging.staging_reviews(t("v_business"), t("v_reviews"))


def scores(t: Tables):
    return recommend.scored(stored(marts.recommendations(t("v_mentions"), t("v_feedback")), "recs"))


@query("scan_reviews", "select gmap_id, business_name, user_id, rating, review_text from {v_sheet}")
def scan_reviews(t):
    return t("v_sheet")


@query(
    "restaurants",
    """select gmap_id, name business_name, address, split_part(address, ',', -2) city
       from {v_business} where contains(category, 'restaurant')""",
)
def restaurants(t):
    return staging.restaurants(t("v_business"))


@query("staging_reviews", f"with {STAGED} select * from staged")
def staging_reviews(t):
    return staged(t)


@query(
    "clean_text",
    "select doc_id, regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g') review_text from {documents}",
)
def clean(t):
    return t("documents").select("doc_id", clean_text(F.col("text")).alias("review_text"))


@query(
    "new_businesses",
    f"""with {STAGED} select distinct business_name from staged x
        where not exists (select 1 from {{v_processed}} p where p.business_name = x.business_name)""",
)
def new_businesses(t):
    return staging.new_businesses(staged(t), t("v_processed"))


@query("processed_businesses", "select distinct business_name from {v_mentions}")
def processed_businesses(t):
    return marts.processed_businesses(t("v_mentions"))


@query(
    "reviews_preview",
    f"""with {STAGED}, placed as (
          select *, row_number() over (partition by business_name
                   order by user_id, review_text, gmap_id, rating) position from staged)
        select business_name, count(*) shown,
               string_agg('- ' || review_text, chr(10) order by position) formatted_reviews
        from placed where position <= 10 group by 1""",
)
def reviews_preview(t):
    return staging.reviews_preview(staged(t))


@query(
    "eta_estimate",
    f"""with {STAGED} select business_name, count(*) reviews, round(count(*) / 60.0, 2) full_minutes,
               round(least(count(*), 100) / 60.0, 2) trial_minutes from staged group by 1""",
)
def eta_estimate(t):
    return staging.time_estimate(staged(t))


@query("business_dim", "select distinct gmap_id, business_name from {v_sheet}")
def business_dim(t):
    return staging.business_dim(t("v_sheet"))


@query(
    "business_lookup",
    """select n.business_name, i.gmap_id
       from (select distinct business_name from {v_mentions}) n
       left join (select business_name, min(gmap_id) gmap_id from {v_sheet} group by 1) i
            on n.business_name = i.business_name""",
)
def business_lookup(t):
    return staging.business_lookup(t("v_mentions").select("business_name").distinct(), t("v_sheet"))


@query(
    "feedback_by_meal",
    f"with {RECS} select * from votes",
)
def feedback_by_meal(t):
    return marts.feedback_by_meal(t("v_feedback"))


@query(
    "recs_view",
    f"""with {RECS} select * replace (round(avg_review_rating, 9) as avg_review_rating,
           round(avg_meal_sentiment, 9) as avg_meal_sentiment) from recs""",
)
def recs_view(t):
    recs = marts.recommendations(t("v_mentions"), t("v_feedback"))
    return rounded(recs, 9, "avg_review_rating", "avg_meal_sentiment")


@query(
    "recs_for_business",
    f"""with {RECS} select * replace (round(avg_review_rating, 9) as avg_review_rating,
           round(avg_meal_sentiment, 9) as avg_meal_sentiment) from recs
        where business_name = 'Supplier#000000003'""",
)
def recs_for_business(t):
    recs = marts.of_business(marts.recommendations(t("v_mentions"), t("v_feedback")), "Supplier#000000003")
    return rounded(recs, 9, "avg_review_rating", "avg_meal_sentiment")


def _norm(measure: str) -> str:
    low, high = f"min({measure}) over w", f"max({measure}) over w"
    return f"round(({measure} - {low}) / nullif({high} - {low}, 0), 9) {measure}_normalized"


@query(
    "minmax_norm",
    f"""with {RECS} select business_name, meal_name, {_norm('total_reviews')},
               {_norm('avg_review_rating')}, {_norm('avg_meal_sentiment')}
        from meals window w as (partition by business_name)""",
)
def minmax_norm(t):
    scaled = recommend.min_max_normalized(stored(marts.meal_reviews(t("v_mentions")), "meals"))
    names = [f"{m}_normalized" for m in ("total_reviews", "avg_review_rating", "avg_meal_sentiment")]
    return rounded(scaled.select("business_name", "meal_name", *names), 9, *names)


@query(
    "recs_score",
    f"""with {SCORED} select business_name, meal_name, total_reviews, total_pos_feedback,
               total_neg_feedback, round(recommendation_score, 9) recommendation_score from scored""",
)
def recs_score(t):
    kept = scores(t).select(
        "business_name", "meal_name", "total_reviews", "total_pos_feedback", "total_neg_feedback",
        "recommendation_score",
    )
    return rounded(kept, 9, "recommendation_score")


@query(
    "recs_final",
    f"""with {SCORED} select business_name, meal_name, round(recommendation_score, 9) recommendation_score,
               total_reviews, round(avg_review_rating, 9) avg_review_rating,
               round(avg_meal_sentiment, 9) avg_meal_sentiment
        from scored where {MENU} order by 1, 3 desc, 2""",
)
def recs_final(t):
    shown = recommend.ranked(scores(t), **RULES)
    return rounded(shown, 9, "recommendation_score", "avg_review_rating", "avg_meal_sentiment")


@query("feedback_menu", f"with {RECS} select business_name, meal_name from recs where {MENU}")
def feedback_menu(t):
    return recommend.feedback_menu(marts.meal_reviews(t("v_mentions")), **RULES)


@query(
    "businesses_without_recs",
    f"""with {RECS} select distinct business_name from {{v_mentions}}
        where business_name not in (select business_name from recs where {MENU} and total_reviews >= 30)""",
)
def businesses_without_recs(t):
    # A stricter review count, so that some businesses have nothing left.
    rows = t("v_mentions")
    return recommend.businesses_without_meals(marts.meal_reviews(rows), rows, least_reviews=30, **RULES)


@query(
    "dietary_grid",
    f"""with {RECS} select business_name, meal_name, q dietary_question,
               'I am eating ' || meal_name || '. ' || q prompt
        from recs, (select unnest([{sql_list(recommend.QUESTIONS)}]) q) where {MENU}""",
)
def dietary_grid(t):
    menu = recommend.menu_filter(marts.meal_reviews(t("v_mentions")), **RULES)
    return recommend.dietary_prompts(menu)


@query(
    "dietary_answers",
    f"""with {RECS} select business_name, meal_name, q dietary_question,
               'Ask about: ' || q dietary_response, date '2024-05-01' create_date
        from recs, (select unnest([{sql_list(recommend.QUESTIONS)}]) q) where {MENU}""",
)
def dietary_answers(t):
    """Answers, here plain text for each question, are appended with their day and read back."""
    store = TableStore(t.spark, scratch_path(t.spark, "store"))
    store.create_empty(["mart.dietary_responses"])
    menu = recommend.menu_filter(marts.meal_reviews(t("v_mentions")), **RULES)
    prompts = recommend.dietary_prompts(menu)
    answered = prompts.withColumn("response", F.concat(F.lit("Ask about: "), F.col("dietary_question")))
    rows = dated(recommend.dietary_responses(answered), "2024-05-01")
    store.append("mart.dietary_responses", rows, "answers-1")
    return store.read("mart.dietary_responses")


@query(
    "meal_rollup",
    """select cluster_label, count(*) cluster_label_count, round(avg(sentiment), 9) sentiment_avg,
              round(avg(rating), 9) rating_avg
       from {v_mentions} where cluster_label is not null group by 1""",
)
def meal_rollup(t):
    return rounded(marts.label_rollup(t("v_mentions")), 9, "sentiment_avg", "rating_avg")


@query(
    "plural_merge",
    """select business_name, rating, meal_name, sentiment, cluster,
              case when exists (select 1 from {v_mentions} y where x.cluster_label = concat(y.cluster_label, 's'))
                   then left(x.cluster_label, length(x.cluster_label) - 1) else x.cluster_label end cluster_label
       from {v_mentions} x""",
)
def plural_merge(t):
    return meals.merge_plurals(t("v_mentions"))


@query(
    "cluster_labels",
    """with counted as (
         select business_name, cluster, meal_name, count(*) n from {v_mentions}
         where meal_name is not null group by 1, 2, 3),
       best as (
         select *, row_number() over (partition by business_name, cluster order by n desc, meal_name) r
         from counted)
       select m.business_name, m.rating, m.meal_name, m.sentiment, m.cluster, b.meal_name cluster_label
       from {v_mentions} m left join best b
            on m.business_name = b.business_name and m.cluster = b.cluster and b.r = 1""",
)
def cluster_labels(t):
    return meals.label_clusters(t("v_mentions").drop("cluster_label"))


@query(
    "cluster_sample_labels",
    "select cluster, cast(least(3, count(*)) as int) labels, true all_of_cluster from {v_mentions} where cluster is not null group by 1",
)
def cluster_sample_labels(t):
    """Up to three labels are drawn per cluster, each of them a meal of that cluster."""
    rows = t("v_mentions").where("cluster is not null")
    drawn = meals.sample_labels(rows).select("cluster", F.posexplode("cluster_label").alias("draw", "meal_name"))
    own = rows.select("cluster", "meal_name").distinct().withColumn("own", F.lit(True))
    return drawn.join(own, ["cluster", "meal_name"], "left").groupBy("cluster").agg(
        F.count("*").cast("int").alias("labels"), F.min(F.coalesce("own", F.lit(False))).alias("all_of_cluster")
    )


@query(
    "sampled_on_rows",
    """select cluster, count(*) mentions, cast(least(3, count(*)) as int) labels, 1::bigint lists, true own_draws
       from {v_mentions} where cluster is not null group by 1""",
)
def sampled_on_rows(t):
    """The drawn labels stand on every mention of their cluster, the same list on each, drawn from its meals."""
    rows = t("v_mentions").where("cluster is not null").drop("cluster_label").withColumn("c", F.lit("kept"))
    found = meals.with_sample_labels(rows)
    own = rows.groupBy("cluster").agg(F.collect_set("meal_name").alias("own"))
    known = found.join(own, "cluster").where("c = 'kept'")
    inside = F.forall("cluster_label", lambda m: F.array_contains("own", m))
    return known.groupBy("cluster").agg(
        F.count("*").alias("mentions"), F.max(F.size("cluster_label")).alias("labels"),
        F.count_distinct("cluster_label").alias("lists"), F.bool_and(inside).alias("own_draws"),
    )


@query(
    "reviews_of_business",
    f"""with {STAGED} select business_name, rating, review_text from staged
        where business_name = (select min(s_name) from {{supplier}} where s_suppkey % 3 < 2)""",
)
def reviews_of_business(t):
    """All reviews of one business, as they go to extraction."""
    chosen = t("supplier").where("s_suppkey % 3 < 2").agg(F.min("s_name").alias("name")).first()["name"]
    return staging.reviews_of(staged(t), chosen)


@query("undouble_quotes", "select doc_id, replace(text, repeat(chr(39), 2), chr(39)) as name from {documents}")
def undouble(t):
    return t("documents").select("doc_id", undouble_quotes(F.col("text")).alias("name"))


@query(
    "sql_cleaning",
    """select lang, count(*) n, cast(sum(length(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g'))) as bigint) chars
       from {documents} group by 1""",
)
def sql_cleaning(t):
    """The cleaning step called from SQL text."""
    register_sql_functions(t.spark)
    return t.spark.sql(
        "select lang, count(*) n, sum(length(clean_special_characters(text))) chars from {documents} group by lang", documents=t("documents")
    )


@query(
    "meal_value_counts",
    "select meal_name, count(*) n from {v_mentions} where meal_name is not null group by 1",
)
def meal_value_counts(t):
    return value_counts(t("v_mentions"), "meal_name")


@query(
    "extraction_stats",
    """select count(*) records, count(distinct meal_name) meals,
              count(distinct meal_name) + max(case when meal_name is null then 1 else 0 end) meals_with_null,
              count(distinct cluster_label) labels from {v_mentions}""",
)
def extraction_stats(t):
    return meals.mention_totals(t("v_mentions"))
