"""Text expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Scheme, then '//', then everything up to the path, query or fragment.
AUTHORITY = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"

# All but a-z, 0-9 and blank, spelled as ranges: Java searches a negated class several times slower.
NOT_PLAIN = r"[\x00-\x1f\x21-\x2f\x3a-\x60\x7b-\x{10ffff}]+"

# Fixed value: default stop words of the word-cloud library.
CLOUD_STOPWORDS = (
    "a about above after again against all also am an and any are aren't as at be because been "
    "before being below between both but by can can't cannot com could couldn't did didn't do does "
    "doesn't doing don't down during each else ever few for from further get had hadn't has hasn't "
    "have haven't having he he'd he'll he's hence her here here's hers herself him himself his how "
    "how's however http i i'd i'll i'm i've if in into is isn't it it's its itself just k let's like "
    "me more most mustn't my myself no nor not of off on once only or other otherwise ought our ours "
    "ourselves out over own r same shall shan't she she'd she'll she's should shouldn't since so some "
    "such than that that's the their theirs them themselves then there there's therefore these they "
    "they'd they'll they're they've this those through to too under until up very was wasn't we we'd "
    "we'll we're we've were weren't what what's when when's where where's which while who who's whom "
    "why why's with won't would wouldn't www you you'd you'll you're you've your yours yourself "
    "yourselves"
).split()


def clean_text(text: Column, unicode_letters: bool = False) -> Column:
    """Lower case without special characters; accents go too unless asked otherwise."""
    drop = r"[^\p{L}\p{N} ]+" if unicode_letters else NOT_PLAIN
    return F.regexp_replace(F.lower(text), drop, "")


def register_sql_functions(spark: SparkSession) -> None:
    """Make the cleaning step callable from SQL text."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION clean_special_characters(t STRING) RETURNS STRING "
        "RETURN regexp_replace(t, '[^a-zA-Z0-9 ]', '')"
    )


def city_of(address: Column) -> Column:
    """Second part from the right; its leading blank stays."""
    return F.split_part(address, F.lit(","), F.lit(-2))


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs without overlap, in any case."""
    if not term:
        raise ValueError("the term must not be empty")
    low = F.lower(text)
    gone = F.replace(low, F.lit(term.lower()), F.lit(""))
    return F.floor((F.length(low) - F.length(gone)) / F.lit(len(term))).cast("bigint")


def url_authority(url: Column) -> Column:
    """Host with user and port; '' where the address has none."""
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit(""))


def day_label(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "MMM dd")


def split_words(text: Column) -> Column:
    """Words as the word-cloud library cuts them: no "'s" at the end, no bare numbers."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_']*"), F.lit(0))
    # Tests of bytes first: a pattern for every word takes most of the time.
    bare = F.transform(found, lambda w: F.when(w.endswith("'s") | w.endswith("'S"), F.left(w, F.length(w) - 2)).otherwise(w))
    return F.filter(bare, lambda w: w.between("A", "\x7f") | ~w.rlike(r"^\p{Nd}+$"))


def strip_stopwords(text: Column, stopwords: list[str]) -> Column:
    kept = F.filter(F.split(text, " "), lambda w: ~F.lower(w).isin(list(stopwords)))
    return F.array_join(kept, " ")


def undouble_quotes(name: Column) -> Column:
    """Repair names stored with SQL-style doubled quotes."""
    return F.replace(name, F.lit("''"), F.lit("'"))
