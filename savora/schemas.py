"""Explicit schemas of every table and payload, as DDL text."""

RAW_BUSINESS = "gmap_id string, name string, address string, category array<string>"
RAW_REVIEWS = "gmap_id string, user_id string, rating int, text string"
STAGING_REVIEWS = (
    "gmap_id string, business_name string, address string, city string, "
    "user_id string, rating int, review_text string"
)
REVIEWS_SHEET = "gmap_id string, business_name string, user_id string, rating int, review_text string"

MEAL_MENTIONS = (
    "business_name string, rating int, meal_name string, sentiment double, "
    "cluster int, cluster_label string"
)
MEAL_CENTRES = "business_name string, cluster int, cluster_label string, centre array<float>"
FEEDBACK = "business_name string, meal_name string, rec_flag boolean, create_date date"
FEEDBACK_PARTIALS = (
    "create_date date, total_feedback bigint, total_pos_feedback bigint, total_neg_feedback bigint, "
    "businesses binary, meals binary"
)
FEEDBACK_STATES = FEEDBACK_PARTIALS + ", stream string, number bigint"
DIETARY_RESPONSES = (
    "business_name string, meal_name string, dietary_question string, "
    "dietary_response string, create_date date"
)

USAGE_METERING = "warehouse_name string, start_time timestamp, credits_used double"
USAGE_BILLING = "usage_date date, credits_billed double"
WEB_SNAPSHOT = (
    "snapshot string, record_id bigint, url string, text string, "
    "last_modified_timestamp bigint, crawl_timestamp bigint"
)

PLACES_PAYLOAD = (
    "results array<struct<place_id string, name string, rating double, user_ratings_total int, "
    "types array<string>, business_status string, formatted_address string, "
    "photos array<struct<photo_reference string, height int, width int>>>>"
)
PLACE_DETAILS_PAYLOAD = (
    "result struct<name string, rating double, formatted_phone_number string, "
    "reviews array<struct<author_name string, rating int, text string>>>"
)
LOCAL_PAYLOAD = (
    "error string, local_results array<struct<title string, rating double, reviews int, "
    "place_id string, data_id string, address string, phone string, website string, "
    "reviews_link string, photos_link string, "
    "gps_coordinates struct<latitude double, longitude double>, thumbnail string>>"
)
REVIEW_PAYLOAD = (
    "place_info struct<title string, address string, rating double, reviews int>, "
    "topics array<struct<keyword string>>, "
    "reviews array<struct<snippet string, link string, "
    "details struct<recommended_dishes string>, images array<string>>>, "
    "images_results array<struct<original string>>"
)

# Layer and schema of each stored table.
TABLES = {
    "raw.business": RAW_BUSINESS,
    "raw.reviews": RAW_REVIEWS,
    "staging.reviews": STAGING_REVIEWS,
    "mart.meal_mentions": MEAL_MENTIONS,
    "mart.meal_centres": MEAL_CENTRES,
    "mart.feedback": FEEDBACK,
    "mart.feedback_partials": FEEDBACK_PARTIALS,
    "mart.feedback_states": FEEDBACK_STATES,
    "mart.dietary_responses": DIETARY_RESPONSES,
}
