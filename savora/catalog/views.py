"""The star-schema test tables seen as review data; one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

VIEWS = {
    "v_business": """
        select cast(s_suppkey as string) gmap_id, s_name as name,
               concat(s_name, ' St, ', n_name, ', ', r_name) address,
               case when s_suppkey % 3 = 0 then 'thai restaurant|bar'
                    when s_suppkey % 3 = 1 then 'Restaurant' else 'shop' end category
        from {supplier} join {nation} on s_nationkey = n_nationkey
             join {region} on n_regionkey = r_regionkey""",
    "v_reviews": """
        select cast(doc_id % 100 as string) gmap_id, cast(doc_id % 37 as string) user_id,
               cast(1 + n_chars % 5 as int) rating,
               case when doc_id % 11 = 0 then null else text end text
        from {documents}""",
    "v_sheet": """
        select r.gmap_id, b.name business_name, r.user_id, r.rating, r.text review_text
        from {v_reviews} r left join {v_business} b on r.gmap_id = b.gmap_id""",
    "v_mentions": """
        select s_name business_name, cast(1 + cast(l_quantity as int) % 5 as int) rating,
               case when p_partkey % 5 = 0 then concat(p_name, 's') else p_name end meal_name,
               l_tax * 10 sentiment, cast(p_partkey % 50 as int) cluster,
               case when l_linenumber = 7 then ''
                    when p_partkey % 5 = 0 then concat(p_name, 's') else p_name end cluster_label
        from {lineitem} join {supplier} on l_suppkey = s_suppkey join {part} on l_partkey = p_partkey""",
    "v_feedback": """
        select s_name business_name, p_name meal_name,
               case l_returnflag when 'A' then true when 'R' then false end rec_flag,
               cast(l_shipdate as date) create_date
        from {lineitem} join {supplier} on l_suppkey = s_suppkey join {part} on l_partkey = p_partkey""",
    "v_processed": """
        select s_name business_name from {lineitem} join {supplier} on l_suppkey = s_suppkey
        where s_acctbal >= 4000""",
    "v_metering": """
        select event_type warehouse_name, ts start_time, value credits_used from {events}""",
    "v_billing": """
        select cast(ts as date) usage_date, value credits_billed from {events}""",
    "v_responses": """
        select l_orderkey * 10 + l_linenumber review_id,
               case when l_orderkey % 7 = 0 then 'No Meals in Review'
                    when l_orderkey % 11 = 0 then 'not a list'
                    when l_linenumber % 2 = 0 then concat('[["', p_name, '", 0.',
                         cast(l_linenumber as string), '], ["', p_type, '", 1]]')
                    else concat('[["', p_name, '", 0.', cast(l_linenumber as string), ']]') end response
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "v_web": """
        select concat('s', cast(user_id % 4 as string)) snapshot, event_id record_id,
               case when event_id % 13 = 0 then null
                    else 1704067200 + event_id * 60
                         + case when event_id % 500 = 0 then 1000000000 else 0 end
               end last_modified_timestamp, 1706000000 + event_id * 90 crawl_timestamp
        from {events}""",
    "v_crawl": """
        select concat('s', cast(page_id % 4 as string)) snapshot, page_id record_id, url from {pages}""",
    "v_crawl_text": """
        select concat('s', cast(page_id % 4 as string)) snapshot, page_id record_id, html text from {pages}""",
    "v_dictionary": """
        select distinct p_name meal_name from {part}""",
}

SNAPSHOTS = ["s0", "s1", "s2", "s3"]
TERMS = ["/en/", "/fr/", "/de/", "example.com", "page=2"]
DENIED_WORDS = ["blue bolt", "red widget"]
DENIED_PART = "ring"
TEXT_TERMS = ["<p>", "the", "</html>", "href"]
WATCHED = ["click", "view", "purchase"]

_NAME = re.compile(r"\{(" + "|".join([*TABLES, *VIEWS]) + r")\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    parts = {p: view(spark, sf_dir, p) for p in _NAME.findall(VIEWS[name])}
    return spark.sql(VIEWS[name], **parts)


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in _NAME.findall(sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)
    return found


def duckdb_sql(sql: str) -> str:
    """Oracle text in which ``{name}`` stands for a table or view, as one statement."""
    def plain(text: str) -> str:
        return _NAME.sub(r"\1", text)

    ctes = [f"{n} as ({plain(VIEWS[n])})" for n in _needed(sql, [])]
    body = plain(sql).strip()
    if not ctes:
        return body
    head = "with " + ",\n".join(ctes)
    return f"{head},\n{body[5:]}" if body.lower().startswith("with ") else f"{head}\n{body}"
