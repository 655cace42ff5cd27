"""The operators over their whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm import bpe_cuts, cap_filters, interleave, packing, prefix_groups, prefix_trie, repetition, secret_ledger, structure_repair, substring_dedup, token_shards, toxicity, warc_salvage
from savora.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return add


@query("op3_interleave")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rows = interleave.interleaved(table(spark, folder, "documents"), shards=40, seed=7)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def _spans_sql() -> str:
    """Spans from the cuts and the matches, as the operator finds them, but by sums over rows."""
    def any_case(word: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

    names = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {
        "assign": (f"({names})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 8),
        "access": ("AKIA[A-Z0-9]+", 0, 16),
        "hex": ("[0-9a-f]+", 0, 32),
        "github": ("gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
        "jwt": ("eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]+", 0, 1),
        "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    }
    parts = []
    for i, (kind, (pattern, group, least)) in enumerate(patterns.items()):
        parts.append(f"""
  select doc_id, {i} as k, '{kind}' as kind, unnest(string_split_regex(t, '{pattern}')) as cut,
         unnest(list_append(regexp_extract_all(t, '{pattern}'), null)) as hit,
         unnest(list_append(regexp_extract_all(t, '{pattern}', {group}), null)) as part,
         generate_subscripts(string_split_regex(t, '{pattern}'), 1) as i, {least} as least
  from d""")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as ({" union all ".join(parts)}),
s as (
  select *, sum(length(cut) + coalesce(length(hit), 0)) over (partition by doc_id, k order by i) as stop from m),
h as (
  select doc_id, k, kind, stop - length(hit) as start, kind || ':' || cast(stop - length(hit) as bigint) || ':' || cast(stop as bigint) as span
  from s where hit is not null and length(part) >= least),
g as (
  select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access,
         count(*) filter (where k = 2) as n_hex,
         coalesce(string_agg(span, ',' order by start, k) filter (where k < 3), '') as base,
         string_agg(span, ',' order by start, k) as spans
  from h group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)"""


@query("op4_secret_ledger", _spans_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = secret_ledger.scanned(docs)
    base = [r.kind for r in secret_ledger.BASE_RULES]
    return rows.select(
        "doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(secret_ledger.written(secret_ledger.listed(base)).cast("binary"), 256).alias("base_sha256"),
        secret_ledger.written(secret_ledger.listed([r.kind for r in secret_ledger.RULES])).alias("spans"),
    )


def _repetition_sql() -> str:
    limits = repetition.COVERAGE_LIMITS
    lengths = sorted({*limits, *repetition.TOP_LIMITS, repetition.BASE_WINDOW})
    lead = ", ".join(f"lead(w, {j}) over o as w{j}" for j in range(1, max(lengths)))
    keys = {n: "w" + "".join(f", w{j}" for j in range(1, n)) for n in lengths}
    repeated = ", ".join(f"i + {n} - 1 <= n_words and count(*) over (partition by doc_id, {keys[n]}) > 1 as d{n}" for n in lengths if n not in repetition.TOP_LIMITS)
    covered = ", ".join(
        f"bool_or(d{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as c{n}" for n in lengths if n not in repetition.TOP_LIMITS
    )
    tops = repetition.TOP_LIMITS
    times = ", ".join(f"case when i + {n} - 1 <= n_words then count(*) over (partition by doc_id, {keys[n]}) end as t{n}" for n in tops)
    sizes = {n: "length(w)" + "".join(f" + length(w{j})" for j in range(1, n)) for n in tops}
    weights = ", ".join(f"case when t{n} > 1 then t{n} * s{n} end as f{n}" for n in tops)
    sums = ", ".join([f"coalesce(sum(length(w)) filter (where c{n}), 0) as k{n}" for n in limits] + [f"coalesce(max(f{n}), 0) as f{n}" for n in tops])
    verdict = " or ".join([f"100 * k{n} > {limits[n]} * word_chars" for n in limits] + [f"100 * f{n} > {tops[n]} * word_chars" for n in tops])
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
x as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d),
w0 as (select doc_id, len(ws) as n_words, unnest(ws) as w, generate_subscripts(ws, 1) as i from x),
w1 as (select *, {lead} from w0 window o as (partition by doc_id order by i)),
w2 as (select doc_id, i, w, {repeated}, {times}, {", ".join(f"{sizes[n]} as s{n}" for n in tops)} from w1),
w3 as (select doc_id, w, {covered}, {weights} from w2),
ws as (
  select doc_id, sum(length(w)) as word_chars, count(*) filter (where c{repetition.BASE_WINDOW}) as n_repeat_words, {sums}
  from w3 group by doc_id),
l0 as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
l1 as (
  select doc_id, line, count(*) as n from l0 where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id, line),
ls as (
  select doc_id, sum(n - 1) as n_dup_lines, sum(n * length(line)) as line_chars, sum((n - 1) * length(line)) as dup_line_chars
  from l1 group by doc_id),
a as (
  select doc_id, len(ws) as n_words, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols from x),
b as (
  select a.*, coalesce(word_chars, 0) as word_chars, coalesce(n_repeat_words, 0) as n_repeat_words,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(line_chars, 0) as line_chars, coalesce(dup_line_chars, 0) as dup_line_chars,
         {", ".join([f"coalesce(k{n}, 0) as k{n}" for n in limits] + [f"coalesce(f{n}, 0) as f{n}" for n in tops])}
  from a left join ws using (doc_id) left join ls using (doc_id)),
v as (
  select *, n_words < {repetition.BASE_WORDS} or 100 * n_repeat_words > {repetition.BASE_REPEATED} * n_words as base_failed,
         {verdict} or 100 * dup_line_chars > {repetition.LINE_LIMIT} * line_chars
         or 100 * n_symbols > {repetition.SYMBOL_LIMIT} * n_words as too_much
  from b)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and not too_much as kept,
       cast(line_chars as bigint) as line_chars, cast(dup_line_chars as bigint) as dup_line_chars
from v"""


@query("op9_repetition", _repetition_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = repetition.with_verdicts(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "dup_line_chars"
    )


@query("op6_bpe_cuts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    rows = bpe_cuts.encoded(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query("op7_token_shards")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_shards.write_shards(table(spark, folder, "documents"), path, end_id=2)
    docs = table(spark, folder, "documents")
    rows = token_shards.fetch(manifest, docs).union(token_shards.read_unkeyed(manifest))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# DuckDB has SHA-1 in hexadecimal only; base32 takes five bits of it at a time.
_WARC = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
h as (select page_id, octet_length(body) as n, sha1(body) as hex from p),
g as (select *, min(page_id) over (partition by hex, n) as first from h)
select page_id, cast(n as bigint) as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast((cast('0x' || substr(hex, 1 + 10 * (i // 8), 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as integer), 1)),
         'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from g"""


@query("op5_warc_salvage", _WARC)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc_salvage.write_archives(table(spark, folder, "pages"))
    rows = warc_salvage.good(warc_salvage.read_archives(archives))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.learn(docs, table(spark, folder, "labels"))
    rows = docs.select("doc_id", toxicity.in_fold(F.col("doc_id")).alias("held_out"), toxicity.scores(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


# Every pair of a small table, then labels that spread along the links.
_CAPS = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v),
l as (
  select a.vec_id as a, b.vec_id as b from u a join u b
  on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.95 * a.n * b.n),
reach(a, b) as (select vec_id, vec_id from v union select reach.a, l.b from reach join l on reach.b = l.a)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links,
       (select min(b) from reach where reach.a = vec_id) as component_id,
       (select min(b) from reach where reach.a = vec_id) = vec_id as kept
from v"""


@query("op1_cap_filters", _CAPS)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, folder, "embeddings"))


_JACCARD = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end as sh from w),
n as (select doc_id, len(sh) as n from s),
e as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 90 * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from n union select reach.a, l.b from reach join l on reach.b = l.a),
m as (select a, min(b) as c from reach group by a)
select doc_id, cast(n as bigint) as n_shingles, c as component_id from n join m on a = doc_id"""


@query("op2_prefix_groups", _JACCARD)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_groups.classes(table(spark, folder, "documents"), width=3, percent=90)


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit; DuckDB has no such function."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: [cast(ascii(ch) as bigint), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda s, b: xor(xor(s, b) >> 1, case when xor(s, b) & 1 = 1 then 3988292384 else 0 end)"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {bits}), {step}), 4294967295)"


_TRIE = f"""
with o as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, turn from conversations where conv_id is not null),
t as (
  select c, md5(length(r) || ':' || r || x) as g, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) as w,
         row_number() over (partition by c order by turn nulls first, r, md5(length(r) || ':' || r || x)) as i
  from o),
h as (select distinct c, {_crc32_sql("cast(c as varchar)")} % 4 as h from t),
p as (
  select c, g, w, 0 as own, i from h join (select c as b, g, w, i from t) on b = c - c % 20 and i <= h
  union all select c, g, w, 1, i from t join h using (c) where i > h),
q as (select c, g, w, row_number() over (partition by c order by own, i) as d from p),
f as (
  select c, string_agg(g, '' order by d) as path, list(w order by d) as ws from q group by c
  union all select c, '', [] from h where c not in (select c from q)),
e as (select c, path, ws, unnest(range(0, len(ws) + 1)) as d from f),
n as (
  select substr(path, 1, 32 * d) as node, d, min(c) as conv, count(*) as n, case when d = 0 then 0 else any_value(ws[d]) end as w,
         sha256(coalesce(string_agg(case when len(ws) = d then cast(c as varchar) end, ',' order by c), '')) as ends
  from e group by 1, 2),
k as (select substr(node, 1, 32 * (d - 1)) as node, count(*) as kids from n where d > 0 group by 1),
m as (select n.*, coalesce(kids, 0) as kids from n left join k using (node)),
u as (
  select substr(node, 1, 32 * up) as node, sum((n - 1) * w) as saved, count(*) filter (where kids = 0) as leaves
  from (select *, unnest(range(0, d + 1)) as up from m) group by 1)
select m.conv as conv_id, m.d as depth, a.conv as parent_conv_id, m.n as n_convs, m.kids as n_children,
       cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, m.ends as ends_sha256
from m join u using (node) left join n a on m.d > 0 and a.node = substr(m.node, 1, 32 * (m.d - 1))"""


@query("op11_prefix_trie", _TRIE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, folder, "conversations"))


_REPAIR = f"""
with recursive o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc32_sql("conv_id || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as harm
  from conversations where conv_id is not null),
d as (
  select conv_id, turn, case when harm = 4 then 'user' else role end as role,
         case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when harm = 3 then [0, 1] when harm = 0 then [] else [0] end) as copy from o),
p0 as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(length(role) || ':' || role || text), copy) as i from d),
p as (select *, row_number() over (partition by conv_id, role, text order by i) as seen from p0),
f as (
  select *, substr(role, 1, 1) as first, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b' when seen > 1 then 'd'
    when regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) not in ('.', '!', '?') then 't' else '' end as fault
  from p),
w as (select *, lag(first) over (partition by conv_id order by i) || first as pair from f),
c as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank,
         count(*) filter (where fault = 'd') as duplicate, count(*) filter (where fault = 't') as truncated,
         count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from w group by 1),
ins(q, q1, audit, fee, text) as (
  values (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 3, chr(10) || 'user:'),
         (1, 2, 'I', 3, chr(10) || 'user:'), (3, 2, 'I', 3, chr(10) || 'user:'), (2, 3, 'I', 3, chr(10) || 'assistant:'),
         (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')),
ed(q1, first, q2, edit, fee, role) as (
  values (0, '', 0, 'D', 4, ''), (1, '', 1, 'D', 4, ''), (2, '', 2, 'D', 4, ''), (3, '', 3, 'D', 4, ''), (0, 's', 1, 'K', 0, ''),
         (0, 'u', 2, 'K', 0, ''), (1, 'u', 2, 'K', 0, ''), (3, 'u', 2, 'K', 0, ''), (2, 'a', 3, 'K', 0, ''), (0, '', 2, 'R', 3, 'user'),
         (1, '', 2, 'R', 3, 'user'), (3, '', 2, 'R', 3, 'user'), (2, '', 3, 'R', 3, 'assistant')),
g as (
  select distinct conv_id, cast(0 as bigint) as i, 0 as q, {{'cost': 0, 'audit': '', 'text': ''}} as best from p
  union all
  select g.conv_id, f.i, q2, min({{'cost': best.cost + ins.fee + ed.fee + case when edit <> 'D' and fault = 't' then 3 else 0 end,
         'audit': best.audit || ins.audit || edit,
         'text': best.text || ins.text || case edit when 'D' then '' when 'K' then chr(10) || f.role || ':' || f.text else chr(10) || ed.role || ':' || f.text end}})
  from g join f on f.conv_id = g.conv_id and f.i = g.i + 1 join ins on ins.q = g.q
  join ed on ed.q1 = ins.q1 and (ed.first = '' or ed.first = f.first) and (edit = 'D' or fault not in ('b', 'd'))
  group by g.conv_id, f.i, q2),
z as (
  select g.conv_id, min({{'cost': best.cost + ins.fee, 'audit': best.audit || ins.audit, 'text': best.text || ins.text}}) as best
  from g join (select conv_id, max(i) as i from p group by 1) using (conv_id, i) join ins on ins.q = g.q and ins.q1 in (0, 3) group by 1)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
       coalesce(best.audit, '') as audit, sha256(coalesce(substr(best.text, 2), '')) as repaired_sha256
from (select distinct conv_id from o) left join c using (conv_id) left join z using (conv_id)"""


@query("op12_structure_repair", _REPAIR)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return structure_repair.repairs(table(spark, folder, "conversations"))


_SUBSTRING = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
w as (
  select doc_id, unnest(range(0, greatest(len(ws) - 12, 0))) as i,
         unnest(list_transform(range(1, greatest(len(ws) - 12, 0) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) as g from d),
r as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as least from w) where doc_id > least),
x as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from d),
c as (
  select x.doc_id, x.i, x.word, r.i is not null as gone
  from x left join (select distinct doc_id, unnest(range(i + 1, i + 14)) as i from r) r using (doc_id, i)),
k as (
  select doc_id, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as kept
  from c group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)"""


@query("op13_substring_dedup", _SUBSTRING)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, folder, "documents"), width=13, digest=True)
