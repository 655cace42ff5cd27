"""Snapshot comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.catalog.registry import query, rounded, sql_list
from savora.catalog.views import SNAPSHOTS, TERMS, TEXT_TERMS
from savora.plans import crawl

STAMP = "last_modified_timestamp"

FRESH = f"""
    known as (select * from {{v_web}} where {STAMP} is not null),
    middle as (select snapshot, median({STAMP}) med from known group by 1),
    away as (select k.*, abs({STAMP} - med) d from known k join middle using (snapshot)),
    spread as (select snapshot, median(d) mad from away group by 1),
    kept as (select snapshot, record_id, {STAMP} from away join spread using (snapshot)
             where mad = 0 or d / mad < 10)"""

EVEN = FRESH + f""",
    placed as (select *, row_number() over (partition by snapshot order by record_id) r from kept),
    even as (select snapshot, record_id, {STAMP} from placed
             where r <= (select min(n) from (select count(*) n from kept group by snapshot)))"""

BINNED = EVEN + f""",
    ends as (select min({STAMP}) low, max({STAMP}) high from even),
    binned as (
        select snapshot, cast(least(floor(({STAMP} - low) * 100 / nullif(high - low, 0)) + 1, 100) as int) bin,
               count(*) n
        from even, ends group by 1, 2)"""


def fresh(t):
    return crawl.freshness(t("v_web"), STAMP, SNAPSHOTS)


@query(
    "snapshot_sample",
    """select snapshot, record_id, url from (
         select *, row_number() over (partition by snapshot order by record_id) r from {v_crawl})
       where r <= 50""",
)
def snapshot_sample(t):
    return crawl.sample(t("v_crawl"), SNAPSHOTS, 50)


@query("mad_filter", f"with {FRESH} select * from kept")
def mad_filter(t):
    return crawl.freshness(t("v_web"), STAMP, SNAPSHOTS, even=False)


@query("snapshot_truncate", f"with {EVEN} select * from even")
def snapshot_truncate(t):
    return fresh(t)


@query(
    "snapshot_stats",
    f"""with {EVEN} select snapshot, count(*) n, min({STAMP}) min_value, round(avg({STAMP}), 4) mean_value,
               max({STAMP}) max_value, strftime(to_timestamp(min({STAMP})) at time zone 'UTC', '%b %d') min_day,
               strftime(to_timestamp(avg({STAMP})) at time zone 'UTC', '%b %d') mean_day,
               strftime(to_timestamp(max({STAMP})) at time zone 'UTC', '%b %d') max_day
        from even group by 1""",
)
def snapshot_stats(t):
    return rounded(crawl.snapshot_stats(fresh(t), STAMP), 4, "mean_value")


@query(
    "ts_histogram",
    f"""with {BINNED},
        every as (select snapshot, cast(unnest(range(1, 101)) as int) bin from (select distinct snapshot from even))
        select snapshot, bin, coalesce(n, 0) n from every left join binned using (snapshot, bin)""",
)
def ts_histogram(t):
    return crawl.histogram(fresh(t), STAMP)


@query(
    "ts_density",
    f"""with {BINNED},
        size as (select snapshot, count(*) total, stddev_samp({STAMP}) spread from even group by 1),
        grid as (select unnest(range(200)) point)
        select b.snapshot, cast(point as int) point, round(low + point * (high - low) / 199.0, 4) x,
               round((high - low) / 100.0 / (first(spread * pow(total, -0.2)) * sqrt(2 * pi()))
                     * sum(n * exp(-0.5 * pow(((low + point * (high - low) / 199.0)
                           - (low + (bin - 0.5) * (high - low) / 100.0)) / (spread * pow(total, -0.2)), 2))), 6) height
        from binned b join size s on b.snapshot = s.snapshot, ends, grid
        group by b.snapshot, point, low, high""",
)
def ts_density(t):
    return rounded(rounded(crawl.density(fresh(t), STAMP), 4, "x"), 6, "height")



TERM_COUNTS = " union all ".join(
    f"""select snapshot, '{x}' term, cast(sum((length(lower(url)) - length(replace(lower(url), '{x}', '')))
        / {len(x)}) as bigint) n from {{v_crawl}} group by 1"""
    for x in TERMS
)


def mentions(t):
    return crawl.term_counts(t("v_crawl"), "url", TERMS, SNAPSHOTS)


@query(
    "crawl_time_stats",
    f"""with {EVEN.replace(STAMP, "crawl_timestamp")}
        select snapshot, count(*) n, min(crawl_timestamp) min_value, max(crawl_timestamp) max_value,
               round(avg(crawl_timestamp), 4) mean_value from even group by 1""",
)
def crawl_time_stats(t):
    """The same comparison for the time of the crawl itself."""
    found = crawl.snapshot_stats(crawl.freshness(t("v_web"), "crawl_timestamp", SNAPSHOTS), "crawl_timestamp")
    return rounded(found.select("snapshot", "n", "min_value", "max_value", "mean_value"), 4, "mean_value")


@query(
    "text_term_counts",
    " union all ".join(
        f"""select snapshot, '{term}' term,
                   cast(sum((length(text) - length(replace(lower(text), '{term}', ''))) // {len(term)}) as bigint) n
            from {{v_crawl_text}} group by 1"""
        for term in TEXT_TERMS
    ),
)
def text_term_counts(t):
    """Terms in the page text instead of the address."""
    return crawl.term_counts(t("v_crawl_text"), "text", TEXT_TERMS, SNAPSHOTS)


# Two hundred pairs of letters, frequent and rare ones.
MANY_TERMS = [a + b for a in "etaoinshrdlcumwf" for b in "etaoinshrdlcu"][:200]


@query(
    "many_term_counts",
    f"""with terms as (select unnest([{sql_list(MANY_TERMS)}]) term), low as (select snapshot, lower(text) x from {{v_crawl_text}})
        select snapshot, term, cast(sum((length(x) - length(replace(x, term, ''))) // length(term)) as bigint) n
        from low, terms group by 1, 2""",
)
def many_term_counts(t):
    """Many short terms that overlap each other."""
    return crawl.term_counts(t("v_crawl_text"), "text", MANY_TERMS, SNAPSHOTS)


@query("term_counts", TERM_COUNTS)
def term_counts(t):
    return mentions(t)


@query(
    "term_share",
    f"""with c as ({TERM_COUNTS})
        select snapshot, term, round(n / nullif(sum(n) over (partition by snapshot), 0), 9) share from c""",
)
def term_share(t):
    return rounded(crawl.term_share(mentions(t)), 9, "share")


DOMAIN = "regexp_extract(url, '^\\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
MATRIX = f"""
    matrix as (
        select {DOMAIN} as "domain", {', '.join(f"count(*) filter (snapshot = '{s}') {s}" for s in SNAPSHOTS)}
        from {{v_crawl}} group by 1)"""


@query("domain_counts", f'select snapshot, {DOMAIN} as "domain", count(*) n from {{v_crawl}} group by 1, 2')
def domain_counts(t):
    return crawl.domain_counts(t("v_crawl"))


def matrix(t):
    return crawl.domain_matrix(t("v_crawl"), SNAPSHOTS)


@query("domain_matrix", f"with {MATRIX} select * from matrix")
def domain_matrix(t):
    return matrix(t)


@query(
    "domain_corr",
    f"with {MATRIX} "
    + " union all ".join(
        f"select '{a}' snapshot_a, '{b}' snapshot_b, round(corr({a}, {b}), 9) corr from matrix"
        for a in SNAPSHOTS
        for b in SNAPSHOTS
    ),
)
def domain_corr(t):
    return rounded(crawl.domain_correlation(matrix(t), SNAPSHOTS), 9, "corr")


# A hundred snapshots: the pages dealt by their number.
WIDE = [f"w{i}" for i in range(100)]


@query(
    "domain_corr_wide",
    f"""with c as (select 'w' || (record_id % 100) snapshot, {DOMAIN} as "domain", count(*) n from {{v_crawl}} group by 1, 2),
        size as (select count(distinct "domain") n from c),
        s as (select w.snapshot, coalesce(sum(n), 0) s, coalesce(sum(n * n), 0) ss
              from (select 'w' || unnest(range(0, 100)) snapshot) w left join c on w.snapshot = c.snapshot group by 1),
        p as (select a.snapshot a, b.snapshot b, sum(a.n * b.n) xy from c a join c b using ("domain") group by 1, 2)
        select x.snapshot snapshot_a, y.snapshot snapshot_b,
               round((size.n * coalesce(xy, 0) - x.s * y.s)
                     / nullif(sqrt(cast(size.n * x.ss - x.s * x.s as double)) * sqrt(cast(size.n * y.ss - y.s * y.s as double)), 0), 9) corr
        from s x join s y on true cross join size left join p on p.a = x.snapshot and p.b = y.snapshot""",
)
def domain_corr_wide(t):
    dealt = t("v_crawl").withColumn("snapshot", F.concat(F.lit("w"), F.col("record_id") % 100))
    return rounded(crawl.snapshot_correlation(crawl.domain_counts(dealt), WIDE), 9, "corr")


@query(
    "domain_top",
    f"""with {MATRIX}, best as (select * from matrix order by s0 desc, s1 desc, s2 desc, s3 desc, "domain" limit 25)
        select "domain", 's0' snapshot, s0 samples from best""",
)
def domain_top(t):
    return crawl.top_domains(matrix(t), SNAPSHOTS)
