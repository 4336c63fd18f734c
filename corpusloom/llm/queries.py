"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, katz, licenses, mixing, neardup, pii, quality, toxicity, vectors
from .common import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(vectors.quantised(table(spark, sf_dir, "embeddings")), k=20)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select *, row_number() over (partition by vec_id order by q) as copy from v),
pairs as (
  select a.vec_id as query_id, a.copy as qcopy, b.vec_id, b.copy,
    cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from n a join n b on len(a.q) = len(b.q) and (a.vec_id <> b.vec_id or a.copy <> b.copy) where a.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id, qcopy order by score desc, vec_id, copy) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(line).alias("text")) for i, r in enumerate(("user", "assistant"))))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(rows))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP3_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc as (
  select *, replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\l'), ':', '\c') as erole,
    replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\l') as etext,
    contains(text, '###') or contains(text, '</turn>') or contains(role, '###') or contains(role, '</turn>') or contains(role, ': ') as bad
  from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(8 + sum(14) + case when bool_or(bad) then sum(length(erole) + length(etext)) else sum(length(role) + length(text)) end as bigint) as formatted_chars
from esc group by conv_id
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"))


OP4_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5('7:' || coalesce(cast(doc_id as varchar), '-') || ':' || md5(coalesce(text, ''))), 1, 15) as bigint) as key
  from documents),
per as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) as number from d group by source),
w as (select *, ([5.0::double, 2.0, 1.0])[cast((number - 1) % 3 + 1 as integer)] as weight, 2.0::double * source_size as cap from per),
l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, number rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, number rows between current row and unbounded following) as own_level from w),
one as (select arg_min(own_level, cap / weight) as level from l where cap / weight > own_level),
t as (select source, source_size, case when level is null then cap else least(cap, weight * level) end as target from l, one),
s as (
  select d.doc_id, d.size, t.source_size, t.target, cast(round(t.target) as bigint) as draw,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as start
  from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(greatest(0, least(start + size, draw) - start) + greatest(0, least(start + source_size + size, draw) - start - source_size) as bigint) as taken from s
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
grams as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as gram from (select doc_id, ws, unnest(generate_series(1, len(ws) - 4)) as i from d where len(ws) >= 5)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, gram) as c from grams) where c > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, generate_series(0, 4) as s(k) group by doc_id),
lines as (select doc_id, count(*) as n, count(*) - count(distinct x) as dup from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
f as (
  select d.doc_id, stratum, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
    len(regexp_extract_all(t, '[A-Z]')) as n_capitals, len(regexp_extract_all(t, '!')) as n_exclamations,
    coalesce(lines.n, 0) as n_lines, coalesce(lines.dup, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
  from d left join covered using (doc_id) left join lines using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f),
lv as (
  select doc_id, stratum, base_failed, rule, cast(least(20, case when y > 0 then floor(20 * x / y) else 0 end) as integer) as level from (
    select doc_id, stratum, base_failed, unnest([0, 1, 2, 3, 4]) as rule, unnest([n_symbols, n_capitals, n_exclamations, n_dup_lines, n_repeat_words]) as x, unnest([n_words, word_chars, n_words, n_lines, n_words]) as y from b)),
known as (select doc_id, min(quality) > 0 as good, substr(md5(cast(doc_id as varchar)), 1, 1) < 'a' as held from labels where quality is not null and doc_id is not null group by doc_id),
fit as (select rule, level, good from lv join known using (doc_id) where not base_failed and not held),
grid as (select r as rule, l as level from generate_series(0, 4) as a(r), generate_series(1, 20) as c(l)),
hits as (select g.rule, g.level, count(*) filter (where fit.good) as g, count(*) filter (where not fit.good) as b from grid g left join fit on fit.rule = g.rule and fit.level >= g.level group by all),
graded as (select rule, level, max(20 * b // (g + b + 1)) over (partition by rule order by level) as grade from hits),
risks as (select lv.doc_id, any_value(stratum) as stratum, bool_or(base_failed) as base_failed, max(coalesce(grade, 0)) as risk from lv left join graded on lv.rule = graded.rule and lv.level = graded.level group by lv.doc_id),
held as (select stratum, risk from risks join known using (doc_id) where not base_failed and held and good),
totals as (select stratum, count(*) as n from held group by stratum),
tests as (select t.stratum, t.n, c.c as cutoff, (select count(*) from held where held.stratum = t.stratum and held.risk >= c.c) as k from totals t, generate_series(10, 20) as c(c)),
tails as (
  select stratum, cutoff, case when k >= n or k > n * 0.02::double then 1.0 else list_sum(list_transform(generate_series(0, k),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02::double) + (n - j) * ln(0.98::double)))) end as tail from tests),
chosen as (select stratum, min(cutoff) as cutoff from tails where tail <= 0.05::double / (select count(*) from totals) group by stratum)
select b.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, b.base_failed, not b.base_failed and coalesce(risk < cutoff, true) as kept
from b join risks using (doc_id) left join chosen on chosen.stratum = b.stratum
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.regexp_count("base", F.lit(rf"\b{kind}:")).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(table(spark, sf_dir, "documents"), width=3, percent=85)


OP8_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sets as (
  select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) as i from d where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared.n >= 85 * (p.n + q.n - shared.n)),
ways as (select x, y from links union all select y, x from links),
reach(doc_id, goal) as (select x, x from ways union select reach.doc_id, ways.y from reach join ways on ways.x = reach.goal),
least_of as (select doc_id, min(goal) as component_id from reach group by doc_id)
select d.doc_id, coalesce(sizes.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept
from d left join sizes using (doc_id) left join least_of using (doc_id)
"""


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def _op10_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    rows = ", ".join(f"('{quoted(k)}', '{quoted(v)}')" for k, v in sorted(licenses.TEMPLATES.items()))
    grams = lambda source, keep: rf"""select {keep}, i - 1 as pos, array_to_string(w[i:i + 4], ' ') as g
  from (select {keep}, w, unnest(generate_series(1, len(w) - 4)) as i from (select {keep}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from {source}) where len(w) >= 5)"""  # noqa: E731
    return rf"""
with templates(license, text) as (values {rows}),
sizes as (select license, len(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as n from templates),
own as (select distinct license, g from ({grams('templates', 'license')})),
totals as (select license, count(*) as total from own group by license),
places as (select distinct doc_id, pos, g from ({grams('documents', 'doc_id')}) where g in (select g from own)),
hits as (
  select doc_id, license, g, n + n // 4 as span, greatest(1, n // 4) as stride, pos, unnest(generate_series(0, (n + n // 4 - 5) // greatest(1, n // 4))) as back
  from places join own using (g) join sizes using (license)),
windows as (
  select doc_id, license, pos // stride - back as win, count(distinct g) as shared from hits
  where pos // stride - back >= 0 and pos <= (pos // stride - back) * stride + span - 5 group by all),
found as (select distinct doc_id, license from windows join totals using (license) where shared * 1000 // total >= 800)
select d.doc_id, count(license) as n_licenses, coalesce(string_agg(license, ',' order by license), '') as licenses
from documents d left join found using (doc_id) group by d.doc_id
"""


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_katz_scores": op9_katz_scores,
    "op10_license_scan": op10_license_scan,
}
SQL = {"op1_exact_topk": OP1_SQL, "op3_chat_format": OP3_SQL, "op4_mix_sources": OP4_SQL, "op6_quality_rules": OP6_SQL, "op8_near_duplicates": OP8_SQL, "op10_license_scan": _op10_sql()}
