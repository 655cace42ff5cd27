"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a Parquet table,
has one row per blob and rule version with the spans found, empty or not. A scan reads only contents
whose blob and rule version are not in the ledger yet, each once however many paths hold it, appends
what it finds, and joins the ledger's findings back to all paths.

Spans are counted in code points, end exclusive, leftmost and without overlaps per rule. Positions come
from cutting the text at the matches: the lengths of the cuts and of the matches add up, chunk by chunk, so
that a text with very many matches takes little more time for each than one with few.

Null contents are the empty text, which has a blob of its own and no findings. Repeated rows, and copies
under other paths, get the same findings. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import text_or_empty
from savora.session import scratch_path, stored


@dataclass(frozen=True)
class Rule:
    """What to look for; a match counts if the measured part of it is long enough."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# The base kinds with their patterns and least lengths. A run that is too short holds no match
# that is long enough, so the lengths of access and hex stand in their patterns; for assign they cannot, as a
# match that is too short still uses up its text.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
# Widely known token formats, on top of the base kinds.
MORE_RULES = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, kind string, version int, spans {SPANS}"


def blob_of(content: str | Column) -> Column:
    return F.sha2(text_or_empty(content).cast("binary"), 256)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; what a lambda refers to outside is worked out at each entry."""
    return F.transform(F.array(value), body)[0]


def _chunks(values: Column, width: int) -> Column:
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int"))
    cut = F.transform(starts, lambda i: F.slice(values, i * width + 1, F.lit(width)))
    return F.when(F.size(values) > 0, cut).otherwise(F.array())


def running(values: Column, combine: Callable[[Column, Column], Column], width: int = 256) -> Column:
    """The values of an array of ints, each combined with all before it.

    Appending copies an array, so chunks have running values of their own, and only one value a chunk runs
    over all of them.
    """
    def last(c: Column) -> Column:
        return F.get(c, F.size(c) - 1)

    def walk(c: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(c, none, lambda before, x: F.concat(before, F.array(F.coalesce(combine(last(before), x), x))))

    def joined(parts: Column, tops: Column) -> Column:
        def lifted(c: Column, i: Column) -> Column:
            return F.when(i == 0, c).otherwise(F.transform(c, lambda x: combine(F.get(tops, i - 1), x)))

        return F.flatten(F.transform(parts, lifted))

    walked = _with(values, lambda bound: F.transform(_chunks(bound, width), walk))
    return _with(walked, lambda parts: _with(walk(F.transform(parts, last)), lambda tops: joined(parts, tops)))


def spans_of(content: Column, rule: Rule) -> Column:
    """The rule's spans in a text, as structs of start and end."""
    whole = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    cuts = F.split(content, rule.pattern, -1)
    # A match ends behind the cuts and matches up to it.
    steps = F.zip_with(
        F.slice(cuts, 1, F.size(whole)),
        F.arrays_zip(whole.alias("m"), measured.alias("g")),
        lambda cut, hit: F.struct(
            (F.char_length(cut) + F.char_length(hit["m"])).alias("step"),
            F.char_length(hit["m"]).alias("size"),
            F.char_length(hit["g"]).alias("least"),
        ),
    )

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda s: s["step"]), lambda a, b: a + b)
        # Those that are too short become null, which keeps their place until the others have theirs.
        spans = F.zip_with(
            found,
            ends,
            lambda s, end: F.when(s["least"] >= rule.least, F.struct((end - s["size"]).alias("start"), end.alias("end"))),
        )
        return F.filter(spans, lambda s: s.isNotNull()).cast(SPANS)

    return F.when(content.rlike(rule.pattern), _with(steps, placed)).otherwise(F.array().cast(SPANS))


def _history(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def scan(versions: DataFrame, ledger: str, content: str = "text", rules: Sequence[Rule] = RULES) -> None:
    """Enter every blob of ``versions`` under every rule version into the ledger, where it is missing."""
    spark = versions.sparkSession
    rows = versions.select(blob_of(content).alias("blob"), text_or_empty(content).alias("content"))
    done = _history(spark, ledger)
    pending = [F.lit(True) for _ in rules]
    if done is not None:
        known = done.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("known"))
        rows = rows.join(known, "blob", "left")
        pending = [~F.coalesce(F.array_contains("known", f"{r.kind}@{r.version}"), F.lit(False)) for r in rules]
        unseen = pending[0]
        for p in pending[1:]:
            unseen = unseen | p
        rows = rows.where(unseen)
    blobs = rows.groupBy("blob").agg(F.first("content").alias("content"), *([F.first("known").alias("known")] if done is not None else []))
    results = F.array(
        *[
            F.when(
                due,
                F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("content"), r).alias("spans")),
            )
            for r, due in zip(rules, pending, strict=True)
        ]
    )
    entries = blobs.select("blob", F.explode(results).alias("r")).where("r is not null").select("blob", "r.*")
    entries.write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per blob with the spans of each rule's kind under the wanted versions."""
    wanted = F.lit(False)
    for r in rules:
        wanted = wanted | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    of = {r.kind: F.max(F.when(F.col("kind") == r.kind, F.col("spans"))).alias(r.kind) for r in rules}
    return spark.read.schema(LEDGER).parquet(ledger).where(wanted).groupBy("blob").agg(*of.values())


def listed(kinds: Sequence[str]) -> Column:
    """All spans of the given kind columns, by start, then in the order of the kinds."""
    def part(i: int, kind: str) -> Column:
        return F.transform(
            F.col(kind),
            lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    parts = [part(i, kind) for i, kind in enumerate(kinds)]
    return F.array_sort(F.concat(*parts))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(versions: DataFrame, ledger: str | None = None, content: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row of ``versions`` with a column of spans per kind, scanned through the ledger.

    Without a ledger folder a fresh one is used, so everything is unseen. A column of ``versions`` named
    like a kind, or like ``blob__``, is not kept.
    """
    spark = versions.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    scan(versions, ledger, content, rules)
    # Written, so that the join can split a blob that very many paths hold.
    found = stored(findings(spark, ledger, rules).withColumnRenamed("blob", "blob__"), "findings")
    kept = [c for c in versions.columns if c.lower() not in {"blob__", *(r.kind for r in rules)}]
    paths = versions.select(*kept).withColumn("blob__", blob_of(content))
    return paths.join(found, "blob__").drop("blob__")


def _replaced(body: Column, spans: Column, width: int = 256) -> Column:
    """The text with its spans, sorted by start, replaced by their kinds; overlapping ones by the first's."""
    def cut(marks: Column) -> Column:
        base = marks[0]["at"]
        # Characters are counted from the start of a text, so the part of some marks is cut out first.
        part = F.substring(body, base + 1, F.element_at(marks, -1)["start"] - base)

        def piece(text: Column) -> Column:
            pieces = F.transform(
                marks,
                lambda m: F.concat(F.substring(text, m["at"] - base + 1, m["start"] - m["at"]), F.lit("["), m["kind"], F.lit("]")),
            )
            return F.array_join(pieces, "")

        return _with(part, piece)

    def whole(reached: Column) -> Column:
        # ``at``: how far all spans before reach.
        marks = F.transform(
            spans,
            lambda s, i: F.struct(
                F.when(i == 0, F.lit(0)).otherwise(F.get(reached, i - 1)).alias("at"), s["start"].alias("start"), s["kind"].alias("kind")
            ),
        )
        kept = F.filter(marks, lambda m: m["start"] >= m["at"])
        pieces = _with(kept, lambda bound: F.array_join(F.transform(_chunks(bound, width), cut), ""))
        return F.concat(pieces, F.substring(body, F.array_max(reached) + 1, F.char_length(body)))

    return _with(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), whole)


def redacted(docs: DataFrame, ledger: str | None = None, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents, all columns kept, with every secret in their text replaced by its kind in brackets.

    Overlapping spans become one replacement. Only blobs with findings are joined back.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    scan(docs, ledger, text, rules)
    kinds = [r.kind for r in rules]
    found = findings(spark, ledger, rules).select(F.col("blob").alias("blob__"), listed(kinds).alias("spans__"))
    found = stored(found.where(F.size("spans__") > 0), "findings")
    rows = docs.withColumn("blob__", blob_of(text)).join(found, "blob__", "left")
    cleaned = _replaced(F.col(text), F.col("spans__"))
    body = F.col(text)
    return rows.withColumn(text, F.when(F.col("spans__").isNotNull(), cleaned).otherwise(body)).select(*docs.columns)
