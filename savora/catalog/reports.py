"""Monitoring and dashboard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.catalog.registry import query, rounded, sql_list
from savora.catalog.views import WATCHED
from savora.functions.text import CLOUD_STOPWORDS
from savora.plans import dashboard, monitoring, partials
from savora.session import scratch_path
from savora.sources.tables import TableStore
from savora.streaming import totals as streamed

DAILY = """
    daily as (
        select create_date, count(distinct business_name) total_restaurants_feedback,
               count(distinct meal_name) total_meals_feedback, count(*) total_feedback,
               cast(sum(case when rec_flag then 1 else 0 end) as bigint) total_pos_feedback,
               cast(sum(case when rec_flag = false then 1 else 0 end) as bigint) total_neg_feedback
        from {v_feedback} group by 1)"""
PERC = "cast(round(total_pos_feedback * 100.0 / total_feedback, 1) as double) positive_feedback_perc"

RATED = """
    rated as (select business_name as name, avg(rating) rating from {v_sheet}
              where business_name is not null group by 1),
    counted as (select business_name as name, count(*) reviews from {v_sheet}
                where business_name is not null group by 1)"""


@query("feedback_daily", f"with {DAILY} select *, {PERC} from daily")
def feedback_daily(t):
    return monitoring.feedback_daily(t("v_feedback"))


_SUMS = ", ".join(f"cast(sum({c}) as bigint) {c}" for c in monitoring.SUMMED)


@query(
    "feedback_total",
    f"""with {DAILY}, summed as (select {_SUMS} from daily)
        select *, {PERC} from summed""",
)
def feedback_total(t):
    return monitoring.feedback_total(monitoring.feedback_daily(t("v_feedback")))


@query(
    "feedback_overall",
    f"""with once as (select null::date create_date, * exclude (create_date) from {{v_feedback}}),
        summed as (
        select count(distinct business_name) total_restaurants_feedback,
               count(distinct meal_name) total_meals_feedback, count(*) total_feedback,
               cast(sum(case when rec_flag then 1 else 0 end) as bigint) total_pos_feedback,
               cast(sum(case when rec_flag = false then 1 else 0 end) as bigint) total_neg_feedback from once)
        select *, {PERC} from summed""",
)
def feedback_overall(t):
    return monitoring.feedback_overall(t("v_feedback"))


# Estimates are compared as facts: no further from the exact count than four standard errors.
_CLOSE = 4 * 1.04 / 2 ** (partials.LG_K / 2)
_EXACT = """
    select {key} count(distinct business_name) restaurants, count(distinct meal_name) meals, count(*) total_feedback,
           cast(sum(case when rec_flag then 1 else 0 end) as bigint) total_pos_feedback,
           cast(sum(case when rec_flag = false then 1 else 0 end) as bigint) total_neg_feedback,
           true restaurants_close, true meals_close
    from {{v_feedback}} {group}"""


def _with_exact(found, feedback, *key):
    """Totals from partials beside the exact distinct counts, and whether the estimates are close to them."""
    # Without a key both are one row.
    exact = feedback.groupBy(*key).agg(F.count_distinct("business_name").alias("restaurants"), F.count_distinct("meal_name").alias("meals"))
    both = found.join(exact, list(key)) if key else found.join(F.broadcast(exact))
    close = {f"{n}_close": F.abs(F.col(f"total_{n}_feedback") - F.col(n)) <= F.col(n) * F.lit(_CLOSE) + 1 for n in ("restaurants", "meals")}
    return both.withColumns(close).select(*key, "restaurants", "meals", *partials.SUMS, *close)


def _loads(t):
    """Two loads of votes, each with its own partials; together they are the whole table."""
    store = TableStore(t.spark, scratch_path(t.spark, "store"))
    store.create_empty([partials.TABLE])
    for n in range(2):
        part = t("v_feedback").where(F.pmod(F.xxhash64("business_name", "meal_name"), F.lit(2)) == n)
        partials.add_load(store, part, f"load-{n}")
    return store.read(partials.TABLE)


@query("feedback_partials_month", _EXACT.format(key="cast(date_trunc('month', create_date) as date) create_month,", group="group by 1"))
def feedback_partials_month(t):
    votes = t("v_feedback").withColumn("create_month", F.trunc("create_date", "month"))
    return _with_exact(partials.totals(partials.by_month(_loads(t))), votes, "create_month")


@query("feedback_partials_overall", _EXACT.format(key="", group=""))
def feedback_partials_overall(t):
    return _with_exact(partials.totals(partials.merged(_loads(t))), t("v_feedback"))


@query("feedback_stream", _EXACT.format(key="create_date,", group="group by 1"))
def feedback_stream(t):
    """All votes landed as files in the order of a hash, so days come mixed, and read by two starts of the stream."""
    store = TableStore(t.spark, scratch_path(t.spark, "store"))
    store.create_empty([streamed.TABLE])
    landing, checkpoint = (scratch_path(t.spark, n) for n in ("landing", "checkpoint"))
    votes = t("v_feedback").select("business_name", "meal_name", F.col("rec_flag").cast("int").alias("feedback"), F.col("create_date").cast("timestamp").alias("voted_at"))
    half = F.pmod(F.xxhash64("meal_name", "voted_at"), F.lit(2))
    for n in range(2):
        votes.where(half == n).write.mode("append").json(landing)
        streamed.keep_totals(store, landing, checkpoint).awaitTermination()
    return _with_exact(streamed.daily_totals(store), t("v_feedback"), "create_date")


@query(
    "usage_total",
    f"""select warehouse_name, round(sum(credits_used), 4) total_credits_used from {{v_metering}}
        where warehouse_name in ({sql_list(WATCHED)}) group by 1 order by 2 desc limit 10""",
)
def usage_total(t):
    return rounded(monitoring.usage_total(t("v_metering"), WATCHED), 4, "total_credits_used")


@query(
    "usage_month",
    """select cast(date_trunc('month', usage_date) as date) usage_month,
              round(sum(credits_billed), 4) credits_billed from {v_billing} group by 1""",
)
def usage_month(t):
    return rounded(monitoring.usage_month(t("v_billing")), 4, "credits_billed")


@query(
    "usage_daily",
    f"""select cast(start_time as date) usage_date, warehouse_name,
               round(sum(credits_used), 4) total_credits_used from {{v_metering}}
        where warehouse_name in ({sql_list(WATCHED)}) group by 1, 2""",
)
def usage_daily(t):
    return rounded(monitoring.usage_daily(t("v_metering"), WATCHED), 4, "total_credits_used")


@query(
    "eda_totals",
    """select count(distinct business_name) + max(case when business_name is null then 1 else 0 end) num_restaurants,
              count(*) num_reviews from {v_sheet}""",
)
def eda_totals(t):
    return dashboard.totals(t("v_sheet"))


@query(
    "eda_avg_rating",
    f"with {RATED} select name, round(rating, 9) rating from rated order by rated.rating desc, name limit 25",
)
def eda_avg_rating(t):
    return rounded(dashboard.top_rated(t("v_sheet")), 9, "rating")


@query(
    "eda_extremes",
    f"""with {RATED}, best as (select * from rated order by rating desc, name limit 25)
        select (select name from best order by rating desc, name limit 1) highest_rated,
               (select name from best order by rating, name limit 1) lowest_rated,
               (select name from rated order by rating desc, name limit 1) highest_overall,
               (select name from rated order by rating, name limit 1) lowest_overall,
               (select name from counted order by reviews desc, name limit 1) most_reviews""",
)
def eda_extremes(t):
    return dashboard.extremes(t("v_sheet"))


@query("eda_popular", f"with {RATED} select name, reviews from counted order by reviews desc, name limit 25")
def eda_popular(t):
    return dashboard.most_reviewed(t("v_sheet"))


@query(
    "eda_user_hist",
    """with users as (select user_id, count(*) reviews from {v_sheet} where user_id is not null group by 1)
       select reviews, count(*) users from users group by 1""",
)
def eda_user_hist(t):
    return dashboard.user_histogram(t("v_sheet"))


@query(
    "eda_map_points",
    f"""with {RATED} select name, reviews, name || ': ' || cast(reviews as varchar) || ' reviews' tooltip
        from counted order by reviews desc, name limit 10""",
)
def eda_map_points(t):
    return dashboard.map_points(t("v_sheet"))


CUT = """
    cut as (
        select list_filter(list_transform(
                   regexp_extract_all(review_text, '[\\p{L}\\p{N}_][\\p{L}\\p{N}_'']*'),
                   lambda w: regexp_replace(w, '''[sS]$', '')),
                   lambda w: not regexp_matches(w, '^\\p{Nd}+$')) ws
        from {v_sheet})"""
STOP = sql_list(CLOUD_STOPWORDS)
WORDS = CUT + f""",
    counts as (
        select lower(w) word, count(*) n from (select unnest(ws) w from cut)
        where lower(w) not in ({STOP}) group by 1)"""


def _fused(name: str, source: str) -> str:
    stem = "case when lower(c.word) like '%s' and lower(c.word) not like '%ss' then left(lower(c.word), length(c.word) - 1) end"
    return f"""
    {name}_spelled as (
        select coalesce(k.low, lower(c.word)) key,
               case when k.low is not null then left(c.word, length(c.word) - 1) else c.word end word, sum(c.n) n
        from {source} c left join (select distinct lower(word) low from {source}) k on k.low = {stem}
        group by 1, 2),
    {name} as (
        select key, (array_agg(word order by n desc, word))[1] word, sum(n)::bigint n
        from {name}_spelled group by 1)"""


CLOUD = CUT + f""",
    singles as (
        select w word, count(*) n from (select unnest(ws) w from cut) where lower(w) not in ({STOP}) group by 1),
    met as (
        select ws[i] a, ws[i + 1] b from (select ws, unnest(range(1, len(ws))) i from cut)),
    pairs as (
        select a || ' ' || b word, count(*) n from met
        where lower(a) not in ({STOP}) and lower(b) not in ({STOP}) group by 1),
    {_fused('terms', 'singles')},
    {_fused('doubles', 'pairs')},
    lows as (select distinct lower(word) low from singles),
    entry as (
        select low, coalesce(s.key, t.key) key, coalesce(s.n, t.n) c from lows
        left join terms s on s.key = case when low like '%s' and low not like '%ss' then left(low, length(low) - 1) end
        left join terms t on t.key = low),
    scored as (
        select d.key, d.word, d.n::double k, e.key key1, f.key key2, e.c::double c1, f.c::double c2,
               (select sum(n) from singles)::double n
        from doubles d join entry e on e.low = split_part(lower(d.word), ' ', 1)
             join entry f on f.low = split_part(lower(d.word), ' ', 2)),
    chosen as (
        select key, word, k::bigint n, key1, key2 from scored where n > c1 and n > c2 and 2 * (
            ln(greatest(k / c1, 1e-10)) * k + ln(greatest(1 - k / c1, 1e-10)) * (c1 - k)
            + ln(greatest((c2 - k) / (n - c1), 1e-10)) * (c2 - k)
            + ln(greatest(1 - (c2 - k) / (n - c1), 1e-10)) * (n - c1 - c2 + k)
            - ln(greatest(c2 / n, 1e-10)) * k - ln(greatest(1 - c2 / n, 1e-10)) * (c1 - k)
            - ln(greatest(c2 / n, 1e-10)) * (c2 - k)
            - ln(greatest(1 - c2 / n, 1e-10)) * (n - c1 - c2 + k)) > 30),
    inside as (
        select key, sum(n) n from (select key1 key, n from chosen union all select key2, n from chosen) group by 1),
    cloud as (
        select t.key, t.word, (t.n - coalesce(i.n, 0))::bigint n from terms t left join inside i on t.key = i.key
        where t.n - coalesce(i.n, 0) > 0
        union all select key, word, n from chosen)"""


@query("word_cloud", f"with {CLOUD} select word, n from cloud order by n desc, key limit 100")
def word_cloud(t):
    return dashboard.cloud_terms(t("v_sheet"))


@query("word_freq", f"with {WORDS} select word, n from counts order by n desc, word limit 100")
def word_freq(t):
    return dashboard.word_counts(t("v_sheet"))


@query(
    "word_freq_plurals",
    f"""with {WORDS}, merged as (
          select coalesce(k.word, c.word) word, sum(c.n)::bigint n
          from counts c left join counts k
               on c.word like '%s' and c.word not like '%ss' and k.word = left(c.word, length(c.word) - 1)
          group by 1)
        select word, n from merged order by n desc, word limit 100""",
)
def word_freq_plurals(t):
    return dashboard.word_counts(t("v_sheet"), merge_plurals=True)


@query(
    "null_profile",
    " union all ".join(
        f"select '{c}' column_name, bool_or({c} is null) has_null from {{v_sheet}}"
        for c in ("gmap_id", "business_name", "user_id", "rating", "review_text")
    ),
)
def null_profile(t):
    return dashboard.null_profile(t("v_sheet"))
