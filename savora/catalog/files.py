"""Sources, sinks and payloads. Payloads are built from table rows, landed as text and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora import schemas
from savora.catalog.registry import joined_text, query
from savora.catalog.views import TABLES
from savora.plans import pairs
from savora.session import scratch_path
from savora.sources import files, json_arrays, payloads, tables


@query(
    "ingest_jsonl",
    'select gmap_id as "GMAP_ID", user_id as "USER_ID", rating as "RATING", text as "TEXT" from {v_reviews}',
)
def ingest_jsonl(t):
    landed = scratch_path(t.spark, "reviews-jsonl")
    files.write_json_lines(t("v_reviews"), landed, compression="gzip")
    rows = files.upper_names(files.read_json_lines(t.spark, landed, schemas.RAW_REVIEWS))
    loaded = scratch_path(t.spark, "reviews-table")
    rows.write.parquet(loaded)
    return t.spark.read.schema(rows.schema).parquet(loaded)


@query("ingest_json_doc", "select conv_id, turn, role, text from {conversations}")
def ingest_json_doc(t):
    landed = scratch_path(t.spark, "documents-json")
    files.write_json_documents(t("conversations"), landed)
    return files.read_json_document(t.spark, landed, "conv_id bigint, turn bigint, role string, text string")


@query("ingest_json_array", "select doc_id, text, lang, source, n_chars from {documents}")
def ingest_json_array(t):
    """Huge documents: every file is cut into ranges of 64 kB, so one array is read by many tasks."""
    landed = scratch_path(t.spark, "array-json")
    files.write_json_documents(t("documents"), landed)
    return json_arrays.read_json_array(t.spark, landed, TABLES["documents"], 1 << 16)


@query("csv_roundtrip", "select doc_id, text, lang, n_chars from {documents}")
def csv_roundtrip(t):
    landed = scratch_path(t.spark, "documents-csv")
    files.write_csv(t("documents").select("doc_id", "text", "lang", "n_chars"), landed)
    return files.read_csv(t.spark, landed, "doc_id bigint, text string, lang string, n_chars bigint")


@query(
    "append_llm_output",
    """select business_name, rating, meal_name, sentiment, cluster, cluster_label
       from {v_mentions} where meal_name <> 'red ring'""",
)
def append_llm_output(t):
    store = tables.TableStore(t.spark, scratch_path(t.spark, "store"))
    rows = t("v_mentions").withColumn(
        "meal_name", F.when(F.col("meal_name") != "red ring", F.col("meal_name"))
    )
    kept = tables.meal_mention_rows(rows)
    early = F.col("cluster") < 25
    store.append("mart.meal_mentions", kept.where(early), "first")
    store.append("mart.meal_mentions", kept.where(~early), "second")
    store.append("mart.meal_mentions", kept.where(~early), "second")
    return store.read("mart.meal_mentions")


@query(
    "append_feedback",
    """select business_name, meal_name, rec_flag, date '2024-05-01' create_date from {v_feedback}""",
)
def append_feedback(t):
    store = tables.TableStore(t.spark, scratch_path(t.spark, "store"))
    store.create_empty(["mart.feedback"])
    votes = t("v_feedback").drop("create_date")
    store.append("mart.feedback", tables.dated(votes, "2024-05-01"), "day-2024-05-01")
    return store.read("mart.feedback")


@query(
    "pairs_nested",
    """select business_name, review_text output_text from {v_sheet}
       where business_name is not null and review_text is not null and rating is not null""",
)
def pairs_nested(t):
    landed = scratch_path(t.spark, "pairs-nested")
    files.write_json_lines(pairs.nested_pairs(pairs.complete_rows(t("v_sheet"))), landed)
    made = files.read_json_lines(t.spark, landed, "input_text struct<business_name string>, output_text string")
    return made.select("input_text.business_name", "output_text")


@query(
    "scan_sheet",
    """select gmap_id, business_name, user_id, rating, nullif(review_text, '') review_text from {v_sheet}""",
)
def scan_sheet(t):
    """The sheet as a CSV export, read by its schema."""
    landed = scratch_path(t.spark, "sheet-csv")
    files.write_csv(files.upper_names(t("v_sheet")), landed)
    return files.read_csv(t.spark, landed, schemas.REVIEWS_SHEET)


@query(
    "pairs_flat",
    """select business_name input_text, review_text output_text from {v_sheet}
       where business_name is not null and review_text is not null and rating is not null""",
)
def pairs_flat(t):
    landed = scratch_path(t.spark, "pairs")
    files.write_json_lines(pairs.flat_pairs(pairs.complete_rows(t("v_sheet"))), landed)
    return files.read_json_lines(t.spark, landed, "input_text string, output_text string")


@query(
    "pairs_first",
    """select business_name, review_text from {v_sheet}
       where business_name is not null and review_text is not null and rating is not null
       order by business_name, review_text, rating limit 800""",
)
def pairs_first(t):
    rows = pairs.complete_rows(t("v_sheet"))
    first = pairs.first_rows(rows, ["business_name", "review_text", "rating"], 800)
    return first.select("business_name", "review_text")


@query("pairs_rest", "select doc_id, source, text from {documents} order by doc_id offset 100")
def pairs_rest(t):
    return pairs.rows_from(t("documents").select("doc_id", "source", "text"), "doc_id", 100)


def _payload(t, table, schema, **fields):
    """One payload per row of ``table``, landed as a line of JSON and read back by its schema."""
    rows = t(table)
    key = rows.columns[0]
    landed = scratch_path(t.spark, "payloads")
    files.write_json_lines(rows.select(key, F.struct(*[v.alias(k) for k, v in fields.items()]).alias("payload")), landed)
    return files.read_json_lines(t.spark, landed, f"{key} bigint, payload struct<{schema}>").select(key, "payload.*")


def _places(t):
    key, name = F.col("s_suppkey"), F.col("s_name")
    hit = lambda i: F.struct(
        F.concat(name, F.lit("-"), i.cast("string")).alias("place_id"),
        name.alias("name"),
        (i + F.lit(0.5)).alias("rating"),
        (key + i).cast("int").alias("user_ratings_total"),
        F.array(F.lit("restaurant"), F.lit("food")).alias("types"),
        F.when(key % 5 != 0, "OPERATIONAL").alias("business_status"),
        F.concat(name, F.lit(" St")).alias("formatted_address"),
        F.array(F.struct(F.concat(F.lit("ref"), i.cast("string")).alias("photo_reference"))).alias("photos"),
    )
    return _payload(
        t, "supplier", schemas.PLACES_PAYLOAD,
        results=F.transform(F.sequence(F.lit(1), (1 + key % 3).cast("int")), hit),
    )


@query(
    "flatten_places",
    """select s_name || '-' || i rest_id, s_name as name, i + 0.5::double rating,
              cast(s_suppkey + i as int) reviews_count, 'restaurant|food' type_of_restaurant,
              case when s_suppkey % 5 <> 0 then 'OPERATIONAL' end business_status,
              s_name || ' St' address, 'ref' || i photos
       from (select *, unnest(range(1, 2 + s_suppkey % 3)) i from {supplier})""",
)
def flatten_places(t):
    landed = scratch_path(t.spark, "places")
    flat = payloads.flatten_places(_places(t))
    files.write_json_lines(flat, landed)
    back = t.spark.read.schema(flat.schema).json(landed)
    return back.withColumn("type_of_restaurant", joined_text(F.col("type_of_restaurant"))).withColumn(
        "photos", joined_text(F.col("photos.photo_reference"))
    )


@query(
    "flatten_place_reviews",
    """select doc_id, 'user ' || (i - 1) author_name, cast(1 + (i - 1) % 5 as int) rating, lines[i] text
       from (select doc_id, lines, unnest(range(1, len(lines) + 1)) i
             from (select doc_id, string_split(text, chr(10)) lines from {documents}))""",
)
def flatten_place_reviews(t):
    lines = F.split("text", "\n")
    reviews = F.transform(
        lines,
        lambda line, i: F.struct(
            F.concat(F.lit("user "), i.cast("string")).alias("author_name"),
            (1 + i % 5).alias("rating"),
            line.alias("text"),
        ),
    )
    parsed = _payload(
        t, "documents", schemas.PLACE_DETAILS_PAYLOAD, result=F.struct(reviews.alias("reviews"))
    )
    return payloads.flatten_place_reviews(parsed, "doc_id")


def _local(t):
    key, name = F.col("c_custkey"), F.col("c_name")
    hit = lambda i: F.struct(
        name.alias("title"),
        F.when(key % 4 != 0, i + F.lit(0.25)).alias("rating"),
        (key * 10 + i).cast("int").alias("reviews"),
        F.concat(F.lit("p"), i.cast("string")).alias("place_id"),
        F.concat(F.lit("d"), key.cast("string")).alias("data_id"),
        F.concat(i.cast("string"), F.lit(" Main St, "), F.col("c_mktsegment")).alias("address"),
        F.when(key % 2 != 0, F.concat(F.lit("+"), key.cast("string"))).alias("phone"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("website"),
        F.concat(F.lit("r/"), name).alias("reviews_link"),
        F.concat(F.lit("f/"), name).alias("photos_link"),
        F.when(
            key % 6 != 0,
            F.struct((F.col("c_nationkey") + 0.5).alias("latitude"), (i + F.lit(0.125)).alias("longitude")),
        ).alias("gps_coordinates"),
        F.when(key % 5 != 0, F.concat(F.lit("t/"), i.cast("string"))).alias("thumbnail"),
    )
    fails = key % 7 == 0
    hits = F.transform(F.sequence(F.lit(1), F.lit(2)), hit)
    return _payload(
        t, "customer", schemas.LOCAL_PAYLOAD,
        error=F.when(fails, F.lit("no results")),
        local_results=F.when(~fails, F.when(key % 11 == 0, F.filter(hits, lambda h: F.lit(False))).otherwise(hits)),
    )


_LOCAL = """(select *, unnest(range(1, 3)) i from {customer} where c_custkey % 7 <> 0 and c_custkey % 11 <> 0)"""


@query(
    "flatten_local",
    f"""select c_name place_name, case when c_custkey % 4 <> 0 then i + 0.25::double end rating,
               cast(c_custkey * 10 + i as int) reviews, 'p' || i place_id, 'd' || c_custkey data_id,
               i || ' Main St, ' || c_mktsegment address, case when c_custkey % 2 <> 0 then '+' || c_custkey end phone,
               case when c_custkey % 3 <> 0 then c_mktsegment end website, 'r/' || c_name reviews_link,
               'f/' || c_name photos_link, case when c_custkey % 5 <> 0 then 't/' || i end thumbnail,
               case when c_custkey % 6 <> 0 then c_nationkey + 0.5::double end latitude,
               case when c_custkey % 6 <> 0 then i + 0.125::double end longitude
        from {_LOCAL}""",
)
def flatten_local(t):
    flat = payloads.flatten_local_results(_local(t))
    return flat.select("*", "gps_coordinates.latitude", "gps_coordinates.longitude").drop("gps_coordinates")


@query("flatten_local_errors", "select c_custkey, 'no results' error from {customer} where c_custkey % 7 = 0")
def flatten_local_errors(t):
    return payloads.local_errors(_local(t), "c_custkey")


@query(
    "payload_geo",
    """select c_custkey, case when ok then c_nationkey + 0.5::double end latitude,
              case when ok then 1.125::double end longitude
       from (select *, c_custkey % 6 <> 0 and c_custkey % 7 <> 0 and c_custkey % 11 <> 0 ok from {customer})""",
)
def payload_geo(t):
    return payloads.first_position(_local(t), "c_custkey")


def _reviews(t):
    """Every line of a document is a review; every third recommends a dish and shows a picture."""
    reviews = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            line.alias("snippet"),
            F.concat(F.lit("link"), i.cast("string")).alias("link"),
            F.when(
                i % 3 == 0, F.struct(F.concat(F.lit("dish"), i.cast("string")).alias("recommended_dishes"))
            ).alias("details"),
            F.when(i % 3 == 0, F.array(F.concat(F.lit("img"), i.cast("string")))).alias("images"),
        ),
    )
    return _payload(
        t, "documents", schemas.REVIEW_PAYLOAD,
        place_info=F.struct(
            F.col("source").alias("title"), F.col("lang").alias("address"),
            F.lit(4.5).alias("rating"), F.col("n_chars").cast("int").alias("reviews"),
        ),
        topics=F.array(F.struct(F.col("lang").alias("keyword")), F.struct(F.col("source").alias("keyword"))),
        reviews=reviews,
        images_results=F.array(F.struct(F.concat(F.lit("pic"), F.col("doc_id").cast("string")).alias("original"))),
    )


_LINES = "(select *, string_split(text, chr(10)) lines from {documents})"


@query(
    "payload_summary",
    f"""select doc_id, source title, replace(array_to_string(lines, ' '), '. ', chr(10)) display_text,
               array_to_string(list_transform(range(0, len(lines), 3), lambda i: 'dish' || i), '') recommended_dishes,
               array_to_string(list_transform(range(0, len(lines), 3), lambda i: 'img' || i), '|') image_urls
        from {_LINES}""",
)
def payload_summary(t):
    return payloads.review_summary(_reviews(t), "doc_id").withColumn(
        "image_urls", joined_text(F.col("image_urls"))
    )


@query("payload_images", "select doc_id, 'pic' || doc_id image_urls from {documents}")
def payload_images(t):
    return payloads.image_links(_reviews(t), "doc_id").withColumn(
        "image_urls", joined_text(F.col("image_urls"))
    )


@query(
    "payload_menu",
    f"""select doc_id, source title,
               'Address: ' || lang || chr(10) || 'Rating: 4.5' || chr(10) || 'Reviews: ' || n_chars description,
               lang || '|' || source menu_items,
               array_to_string(list_transform(range(0, len(lines)), lambda i: 'link' || i), '|') links
        from {_LINES}""",
)
def payload_menu(t):
    card = payloads.place_card(_reviews(t), "doc_id")
    return card.withColumn("menu_items", joined_text(F.col("menu_items"))).withColumn(
        "links", joined_text(F.col("links"))
    )
