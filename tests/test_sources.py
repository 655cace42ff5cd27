"""Files and stored tables."""

import datetime

from pyspark.sql import functions as F

from savora import schemas
from savora.session import scratch_path, shared_folder, stored
from savora.sources import files, payloads, tables


def test_csv_keeps_odd_text(spark):
    texts = ['a "quoted" one', "two\nlines", None, " blanks ", "comma, end", '"', "back\\slash"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    path = scratch_path(spark, "csv")
    files.write_csv(rows, path)
    assert [r.t for r in files.read_csv(spark, path, "id int, t string").orderBy("id").collect()] == texts
    blank = scratch_path(spark, "csv")
    files.write_csv(spark.createDataFrame([(1, "")], "id int, t string"), blank)
    assert files.read_csv(spark, blank, "id int, t string").first().t is None


def test_json_documents(spark):
    rows = spark.range(25).select("id", F.concat(F.lit("x\n"), "id").alias("t")).repartition(3)
    for frame in (rows, rows.where("false")):
        path = scratch_path(spark, "json")
        files.write_json_documents(frame, path)
        back = files.read_json_document(spark, path, "id bigint, t string")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))


def test_store(spark):
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    store.create_empty()
    assert store.read("mart.feedback").count() == 0
    votes = spark.createDataFrame([("Anna's", "taco", True)], "business_name string, meal_name string, rec_flag boolean")
    store.append("mart.feedback", tables.dated(votes, "2024-02-03"), "one")
    store.append("mart.feedback", tables.dated(votes, "2024-02-03"), "one")
    store.append("mart.feedback", tables.dated(votes), "two")
    found = store.read("mart.feedback")
    assert found.count() == 2 and found.columns[-1] == "create_date"
    assert found.where("create_date = date '2024-02-03'").count() == 1
    store.register_views(["mart.feedback", "raw.business"])
    assert {"mart_feedback", "raw_business"} <= {t.name for t in spark.catalog.listTables()}
    assert spark.sql("select count(*) n from mart_feedback").first().n == 2
    store.replace("mart.feedback", tables.dated(votes, "2024-02-04"))
    assert [r.create_date for r in store.read("mart.feedback").collect()] == [datetime.date(2024, 2, 4)]


def test_optional_payload_keys(spark):
    bodies = ['{"place_info": {"title": "T"}, "reviews": [{"snippet": "a. b"}, {"link": "l"}]}', "{}"]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    parsed = files.with_json(rows, "body", f"struct<{schemas.REVIEW_PAYLOAD}>").select("payload.*")
    first = payloads.review_summary(parsed).collect()[0]
    assert (first.title, first.display_text, first.recommended_dishes, first.image_urls) == ("T", "a\nb", "", [])
    card = payloads.place_card(parsed).collect()
    assert card[0].links == [None, "l"] and card[1].links is None


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_stored(spark):
    rows = spark.range(10, numPartitions=1)
    assert stored(rows, "x").count() == 10


def test_gzip_lines_can_be_spread(spark):
    path = scratch_path(spark, "gz")
    files.write_json_lines(spark.range(20).select("id"), path, compression="gzip")
    rows = files.upper_names(files.read_json_lines(spark, path, "id bigint", partitions=5))
    assert rows.columns == ["ID"] and rows.rdd.getNumPartitions() == 5 and rows.count() == 20


def test_dictionary_payload_without_results(spark):
    rows = spark.createDataFrame([('{"error": "e"}',), ('{"local_results": []}',)], "body string")
    parsed = files.with_json(rows, "body", f"struct<{schemas.LOCAL_PAYLOAD}>").select("payload.*")
    assert payloads.flatten_local_results(parsed).count() == 0
    assert payloads.local_errors(parsed).first().error == "e"
    assert [tuple(r) for r in payloads.first_position(parsed).collect()] == [(None, None)] * 2
