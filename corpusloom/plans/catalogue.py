"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import engines, methods


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL building blocks.
def sql_sentences(x: str) -> str:
    """The engine of the SQL side has no look-behind: mark the ends first, then split at the marks."""
    parts = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return rf"list_filter(list_transform({parts}, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def sql_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def _sql_natural(x: str) -> str:
    w = sql_words(x)
    n, s, q = f"len({w})", f"list_sum(list_transform({w}, lambda w: length(w)))", f"list_sum(list_transform({w}, lambda w: length(w) * length(w)))"
    return f"case when {n} = 0 then 0.0::double else 0.6::double * (len(list_distinct({w}))::double / {n}) + least(({n} * {q} - {s} * {s})::double / ({n} * {n}) / 10, 0.4::double) end"


_STYLE = f"""
with d as (select *, {sql_sentences('text')} as s, {sql_words('text')} as w from documents),
words as (select doc_id, lower(unnest(w)) as word from d),
counts as (select doc_id, word, count(*) as c from words group by all),
hapax as (select doc_id, sum(case when c = 1 then 1 else 0 end)::double / count(*) as hapax, count(*) as types from counts group by doc_id),
lens as (select *, len(s) as n, len(w) as nw, list_transform(s, lambda x: len({sql_words('x')})) as ls from d),
mom as (select *, coalesce(list_sum(ls), 0) as sm, coalesce(list_sum(list_transform(ls, lambda l: l * l)), 0) as sq from lens),
style as (
  select m.doc_id, m.lang, m.n as n_sentences, m.nw as n_words, h.types::double / nullif(m.nw, 0) as ttr,
    case when n > 0 then sm::double / n end as mean_len,
    case when sm > 0 then sqrt((n * sq - sm * sm)::double / (n * n)) / (sm::double / n) else 0.0 end as cv, coalesce(h.hapax, 0.0) as hapax_ratio
  from mom m left join hapax h using (doc_id)),
scored as (
  select *, case when n_sentences < 2 or n_words = 0 then 0.5 else (
    greatest(0, least(1, (0.7::double - ttr) / 0.3::double)) + greatest(0, least(1, (0.5::double - cv) / 0.3::double)) + greatest(0, least(1, (0.6::double - hapax_ratio) / 0.3::double))) / 3 end as stat_score
  from style)
"""

_PREFIX = "We Utilize robust methodology. We utilize it again. Furthermore, it works. "


def _prefix(table: str) -> str:
    """Text that holds words of the lexicon; before short texts also letters whose lower case is longer."""
    return _PREFIX if table == "documents" else "İİ " + _PREFIX



def _style(spark, d) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", "lang", scores.stylometry(F.col("text")).alias("s")).select("doc_id", "lang", "s.*")


def stat_score(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    return _style(spark, d).select("doc_id", "n_sentences", "n_words", r("ttr"), r("mean_len"), r("cv"), r("hapax_ratio"), r("stat_score"))


def stat_score_by_lang(spark, d):
    return _style(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("stat_score"), 6).alias("avg_score"))


def stat_score_by_quality(spark, d):
    labels = _table(spark, d, "labels").select("doc_id", "quality")
    return _style(spark, d).join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("stat_score"), 6).alias("avg_score"))


def flag_threshold(spark, d):
    # inline() keeps the filter above the score, which would else be computed in the filter and again beside it
    score = F.round(scores.stylometry(F.col("text"))["stat_score"], 9)
    return _table(spark, d, "documents").select("doc_id", F.inline(F.array(F.struct(score.alias("stat_score"))))).where("stat_score > 0.5")


def sentence_split(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def sentence_split_cjk(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences_cjk(F.regexp_replace("text", r"\.", "。"))).alias("pos", "sentence"))


def word_count(spark, d):
    one = lambda name, key: _table(spark, d, name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), F.size(T.words(F.col("text"))).alias("n_words"))
    return one("documents", "doc_id").unionByName(one("benchmark", "item_id"))


def word_histogram(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.inline(scores.histogram(F.col("text"))))


def naturalness(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.round(scores.naturalness(F.col("text")), 9).alias("naturalness"))


def clamp_perplexity(spark, d):
    return _table(spark, d, "events").select("event_id", F.round(scores.perplexity_score(F.col("value")), 9).alias("score"))


def fold_label(spark, d):
    name = F.when(F.col("quality") == 1, "LABEL_0").when(F.col("toxic") == 1, "Fake").otherwise("LABEL_1")
    score = F.pmod("doc_id", F.lit(10)) / 10
    return _table(spark, d, "labels").select("doc_id", F.round(scores.label_score(name, score), 9).alias("score"))


def _ensemble_mean(table, key):
    def run(spark, d):
        t = F.col("text")
        three = scores.ensemble(scores.naturalness(t), scores.stylometry(t)["stat_score"], scores.perplexity_score(F.length(t).cast("double")))
        return _table(spark, d, table).select(key, F.round(three, 9).alias("score"))

    return run


def _lexicon_replace(table, key):
    def run(spark, d):
        text = F.concat(F.lit(_prefix(table)), F.col("text"))
        return _table(spark, d, table).select(key, T.replace_lexicon(text, choose=T.choose_by(F.col(key))).alias("result"))

    return run


def rhythm_merge(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.merge_rhythm(F.col("text")).alias("result"))


def _postprocess(table, key):
    def run(spark, d):
        text = F.concat(F.lit(_prefix(table)), F.col("text"))
        return _table(spark, d, table).select(key, T.postprocess(text).alias("result"))

    return run


def chunk_pack(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.posexplode(T.pack_chunks(F.col("text"), 1000)).alias("chunk_no", "chunk"))


def chunk_map_join(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.chunk_map(F.col("text"), lambda c: F.concat(F.lit("<"), c, F.lit(">")), 4500).alias("result"))


def _hop_chain(tier):
    def run(spark, d):
        return methods.run_method(_table(spark, d, "benchmark"), "translation_chain", tier=tier).select("item_id", "result", "method_used")

    return run


def multi_round(spark, d):
    return methods.run_method(_table(spark, d, "benchmark"), "llm_rewrite", rounds=5).select("item_id", "result")


_SIDES = {"google": engines.swap_case, "mymemory": lambda t, s, g: F.concat(t, F.lit(" "), t), "broken": engines.failing}


def best_of_n(spark, d):
    return methods.best_of(_table(spark, d, "benchmark"), _SIDES, ("broken", "google", "mymemory")).select("item_id", "result")


def feedback_loop(spark, d):
    score = lambda s: F.size(T.words(s)) / 20
    rewrite = lambda s: F.concat(F.lit("("), F.substr(s, F.lit(1), F.lit(40)), F.lit(")"))
    return methods.scored_loop(_table(spark, d, "benchmark"), score, rewrite, rounds=2, first=lambda t: t).select("item_id", "result")


def feedback_loop_default(spark, d):
    """One round with the default steps: post-processing, naturalness, lexicon."""
    rows = _table(spark, d, "benchmark").withColumn("text", F.concat(F.lit(_prefix("benchmark")), "text"))
    return methods.run_method(rows, "detection_guided", rounds=1).select("item_id", "result")


def standard_chain_trace(spark, d):
    return methods.standard_chain(_table(spark, d, "benchmark")).select("item_id", F.inline("steps"))


def chat_messages(spark, d):
    rows = _table(spark, d, "conversations")
    history = F.when(F.col("turn") > 0, F.struct(F.col("role").alias("input"), F.col("text").alias("output")))
    made = rows.select("conv_id", "turn", T.chat_messages(F.lit("Be brief."), F.col("text"), history).alias("m"))
    return made.select("conv_id", "turn", F.posexplode("m").alias("pos", "m")).select("conv_id", "turn", "pos", "m.role", "m.content")


def json_extract(spark, d):
    k = F.from_json("props", "k long")
    return _table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), k["k"].alias("number"), F.length(F.to_json(k)).alias("n"))


def segments_join(spark, d):
    """Nested JSON lists, as a translation service answers with, flattened and joined."""
    body = F.to_json(F.array(F.transform(T.sentences(F.col("text")), lambda x: F.array(x, F.lit("source")))))
    return _table(spark, d, "documents").select("doc_id", T.segments_text(body).alias("result"))


def translation_response(spark, d):
    body = F.to_json(F.struct(F.col("text").alias("tgt_text"), F.lit(None).cast("string").alias("error_msg")))
    return _table(spark, d, "benchmark").select("item_id", T.translation_text(body).alias("result"))


def chat_request(spark, d):
    messages = T.chat_messages(F.lit("Be brief."), F.col("text"))
    return _table(spark, d, "conversations").select("conv_id", "turn", T.request_json("chat", messages, 1.3, 0.9).alias("body"))


def _echo():
    """An offline service: answers with the number of messages and the last one."""
    import json

    def answer(body: str) -> str:
        messages = json.loads(body)["messages"]
        return json.dumps({"choices": [{"message": {"content": f" {len(messages)} {messages[-1]['content']}\n"}}]})

    return lambda bodies: [answer(b) for b in bodies]


def rewrite_call(spark, d):
    call = engines.chat_rewriter(_echo, "Be brief.", "chat")
    once = _table(spark, d, "benchmark").select("item_id", "text", call(F.col("text")).alias("first"))
    history = F.struct(F.col("text").alias("input"), F.col("first").alias("output"))
    return once.select("item_id", "first", call(F.col("first"), history).alias("second"))


def model_perplexity(spark, d):
    """A stand-in model: the perplexity of a text is its length modulo 150."""
    model = engines.scorer(lambda: lambda texts: [float(len(t) % 150) for t in texts])
    return _table(spark, d, "documents").select("doc_id", F.round(scores.perplexity_score(model(F.col("text"))), 9).alias("score"))


def response_bodies(spark, d):
    """Result, method and milliseconds as a service returns them, from settings that have headers."""
    headers = T.header_map(HTTP_Referer=F.col("source"), X_Title=F.lit(""))
    body = F.to_json(F.struct(F.col("n_chars").alias("result"), T.whole_milliseconds(F.col("n_chars") / 8).alias("processing_time_ms"), headers.alias("headers")))
    return _table(spark, d, "documents").select("doc_id", body.alias("body"))


def lang_map(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.lang_code(F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))).alias("code"))


def url_normalise(spark, d):
    return _table(spark, d, "pages").select("page_id", T.completions_url(F.col("url")).alias("url"))


def _sql_steps(key: str | None, table: str = "benchmark", row: str = "item_id") -> str:
    """The lexicon as a chain of common tables, one per word."""
    out = [f"t0 as (select {row}, '{_prefix(table)}' || text as t from {table})"]
    for rank, (word, options) in enumerate(T.LEXICON.items()):
        pick = f"case ({key} + {rank}) % 3 " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(options)) + " end" if key else f"'{options[0]}'"
        out.append(f"t{rank + 1} as (select {row}, regexp_replace(t, '(?is)^(.*?){word}', '\\1' || {pick}) as t from t{rank})")
    return ",\n".join(out)


def _sql_lexicon(x: str) -> str:
    for word, options in T.LEXICON.items():
        x = f"regexp_replace({x}, '(?is)^(.*?){word}', '\\1{options[0]}')"
    return x


def _sql_rhythm(source: str, key: str, text: str) -> str:
    """Gaps and islands: within a run of short sentences, odd ones take the next and even ones go."""
    return rf"""
src as (select {key} as id, {text} as text, {sql_sentences(text)} as s from {source}),
items as (select id, unnest(s) as x, generate_subscripts(s, 1) as pos from src where len(s) >= 3),
runs as (select *, len({sql_words('x')}) < 8 as short from items),
islands as (select *, sum(case when short then 0 else 1 end) over (partition by id order by pos) as island from runs),
numbered as (select *, row_number() over (partition by id, island, short order by pos) as k,
  lead(short) over (partition by id order by pos) as next_short, lead(x) over (partition by id order by pos) as next_x from islands),
merged as (select id, pos, case when short and k % 2 = 1 and next_short then
  regexp_replace(x, '[.!?]+$', '') || ' — ' || lower(substr(next_x, 1, 1)) || substr(next_x, 2) else x end as y
  from numbered where not (short and k % 2 = 0)),
joined as (select id, string_agg(y, ' ' order by pos) as y from merged group by id)
"""


def _sql_hops(tier: str) -> str:
    expr = "text"
    for engine, source, target in methods.hops(tier):
        expr = f"'[{engine} {source}>{target}] ' || {expr}"
    return f"select item_id, {expr} as result, 'translation_chain' as method_used from benchmark"


_FEEDBACK = f"""
with r0 as (select item_id, text as t from benchmark),
r1 as (select item_id, case when len(list_filter({sql_sentences('t')}, lambda x: len({sql_words('x')})::double / 20 > 0.5)) > 0 then
  array_to_string(list_transform({sql_sentences('t')}, lambda x: case when len({sql_words('x')})::double / 20 > 0.5 then '(' || substr(x, 1, 40) || ')' else x end), ' ') else t end as t from r0)
select item_id, case when len(list_filter({sql_sentences('t')}, lambda x: len({sql_words('x')})::double / 20 > 0.5)) > 0 then
  array_to_string(list_transform({sql_sentences('t')}, lambda x: case when len({sql_words('x')})::double / 20 > 0.5 then '(' || substr(x, 1, 40) || ')' else x end), ' ') else t end as result from r1
"""

_BEST = f"""
with s as (select item_id, unnest({sql_sentences('text')}) as x, generate_subscripts({sql_sentences('text')}, 1) as pos from benchmark),
c as (select item_id, pos, upper(substr(x, 1, 1)) || lower(substr(x, 2)) as a, x || ' ' || x || ' ' || x || ' ' || x as b from s),
v as (select *, round({_sql_natural('a')}, 9) as na, round({_sql_natural('b')}, 9) as nb from c)
select item_id, string_agg(case when nb > na then b else a end, ' ' order by pos) as result from v group by item_id
"""

_CHUNKS = r"""
with recursive p as (select doc_id, text, string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) as s from documents),
walk as (
  select doc_id, s, 1 as i, '' as cur, cast(null as varchar) as done, 0 as no from p
  union all
  select doc_id, s, i + 1,
    case when length(cur) + length(s[i]) + 1 > 1000 then s[i] else regexp_replace(cur || ' ' || s[i], '^\s+|\s+$', '', 'g') end,
    case when length(cur) + length(s[i]) + 1 > 1000 and cur <> '' then cur end,
    no + case when length(cur) + length(s[i]) + 1 > 1000 and cur <> '' then 1 else 0 end
  from walk where i <= len(s)),
out as (
  select doc_id, no - 1 as chunk_no, done as chunk from walk where done is not null
  union all select doc_id, no, cur from walk where i = len(s) + 1 and cur <> '')
select doc_id, cast(chunk_no as integer) as chunk_no, chunk from out
union all select p.doc_id, 0, p.text from p where not exists (select 1 from out where out.doc_id = p.doc_id)
"""

QUERIES = {
    "stat_score": stat_score, "stat_score_by_lang": stat_score_by_lang, "stat_score_by_quality": stat_score_by_quality,
    "flag_threshold": flag_threshold, "sentence_split": sentence_split, "sentence_split_cjk": sentence_split_cjk,
    "word_count": word_count, "word_histogram": word_histogram, "naturalness": naturalness,
    "clamp_perplexity": clamp_perplexity, "fold_label": fold_label, "ensemble_mean": _ensemble_mean("benchmark", "item_id"),
    "lexicon_replace": _lexicon_replace("benchmark", "item_id"), "rhythm_merge": rhythm_merge, "postprocess": _postprocess("benchmark", "item_id"),
    "ensemble_mean_documents": _ensemble_mean("documents", "doc_id"), "lexicon_replace_documents": _lexicon_replace("documents", "doc_id"), "postprocess_documents": _postprocess("documents", "doc_id"),
    "chunk_pack": chunk_pack, "chunk_map_join": chunk_map_join,
    "hop_chain_standard": _hop_chain("standard"), "hop_chain_advanced": _hop_chain("advanced"), "hop_chain_focus": _hop_chain("focus"),
    "multi_round": multi_round, "best_of_n": best_of_n, "feedback_loop": feedback_loop,
    "standard_chain_trace": standard_chain_trace, "chat_messages": chat_messages, "json_extract": json_extract, "segments_join": segments_join,
    "translation_response": translation_response, "chat_request": chat_request, "rewrite_call": rewrite_call, "model_perplexity": model_perplexity,
    "response_bodies": response_bodies, "feedback_loop_default": feedback_loop_default,
    "lang_map": lang_map, "url_normalise": url_normalise,
}

SQL = {
    "stat_score": _STYLE + "select doc_id, n_sentences, n_words, round(ttr, 9) as ttr, round(mean_len, 9) as mean_len, round(cv, 9) as cv, round(hapax_ratio, 9) as hapax_ratio, round(stat_score, 9) as stat_score from scored",
    "stat_score_by_lang": _STYLE + "select lang, count(*) as n, round(avg(stat_score), 6) as avg_score from scored group by lang",
    "stat_score_by_quality": _STYLE + "select quality, count(*) as n, round(avg(stat_score), 6) as avg_score from scored join labels using (doc_id) group by quality",
    "flag_threshold": _STYLE + "select doc_id, round(stat_score, 9) as stat_score from scored where round(stat_score, 9) > 0.5",
    "sentence_split": f"with s as (select doc_id, {sql_sentences('text')} as s from documents) select doc_id, unnest(generate_series(0, len(s) - 1)) as pos, unnest(s) as sentence from s",
    "sentence_split_cjk": r"with s as (select doc_id, string_split(regexp_replace(replace(text, '.', '。'), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) as s from documents) select doc_id, unnest(generate_series(0, len(s) - 1)) as pos, unnest(s) as sentence from s",
    "word_count": f"select 'documents' as origin, doc_id as id, len({sql_words('text')}) as n_words from documents union all select 'benchmark', item_id, len({sql_words('text')}) from benchmark",
    "word_histogram": f"with w as (select doc_id, lower(unnest({sql_words('text')})) as word from documents) select doc_id, word, count(*) as n from w group by all",
    "naturalness": f"select doc_id, round({_sql_natural('text')}, 9) as naturalness from documents",
    "clamp_perplexity": "select event_id, round(greatest(0.0::double, least(1.0::double, 1 - (value - 10) / 100)), 9) as score from events",
    "fold_label": "select doc_id, round(case when quality = 1 then 1 - (doc_id % 10)::double / 10 else (doc_id % 10)::double / 10 end, 9) as score from labels",
    "lexicon_replace": f"with {_sql_steps('item_id')} select item_id, t as result from t30",
    "rhythm_merge": f"with {_sql_rhythm('documents', 'doc_id', 'text')} select src.id as doc_id, coalesce(joined.y, src.text) as result from src left join joined using (id)",
    "postprocess": f"with {_sql_steps(None)}, {_sql_rhythm('t30', 'item_id', 't')} select src.id as item_id, coalesce(joined.y, src.text) as result from src left join joined using (id)",
    "lexicon_replace_documents": f"with {_sql_steps('doc_id', 'documents', 'doc_id')} select doc_id, t as result from t30",
    "postprocess_documents": f"with {_sql_steps(None, 'documents', 'doc_id')}, {_sql_rhythm('t30', 'doc_id', 't')} select src.id as doc_id, coalesce(joined.y, src.text) as result from src left join joined using (id)",
    "ensemble_mean_documents": _STYLE + f"select doc_id, round(({_sql_natural('text')} + stat_score + greatest(0.0::double, least(1.0::double, 1 - (length(text) - 10)::double / 100))) / 3, 9) as score from (select doc_id, stat_score from scored) join documents using (doc_id)",
    "json_extract": "select event_id, json_extract_string(props, '$.k') as k, cast(json_extract_string(props, '$.k') as bigint) as number, length(to_json({'k': cast(json_extract_string(props, '$.k') as bigint)})) as n from events",
    "chunk_pack": _CHUNKS,
    "chunk_map_join": f"select doc_id, case when length(any_value(text)) > 4500 then string_agg('<' || chunk || '>', ' ' order by chunk_no) else '<' || any_value(text) || '>' end as result from ({_CHUNKS.replace('1000', '4500')}) c join documents using (doc_id) group by doc_id",
    "ensemble_mean": _STYLE.replace("from documents", "from (select item_id as doc_id, '' as lang, text from benchmark)") + f"select doc_id as item_id, round(({_sql_natural('text')} + stat_score + greatest(0.0::double, least(1.0::double, 1 - (length(text) - 10)::double / 100))) / 3, 9) as score from scored join benchmark on item_id = doc_id",
    "hop_chain_standard": _sql_hops("standard"), "hop_chain_advanced": _sql_hops("advanced"), "hop_chain_focus": _sql_hops("focus"),
    "multi_round": "select item_id, '(round 3) (round 2) (round 1) ' || text as result from benchmark",
    "best_of_n": _BEST,
    "feedback_loop": _FEEDBACK,
    "standard_chain_trace": """with c as (select item_id, '[zh] ' || text as a, '[ja] [zh] ' || text as b, '[google ja>fi] [ja] [zh] ' || text as c, '[mymemory fi>en] [google ja>fi] [ja] [zh] ' || text as d from benchmark)
select item_id, 1 as step, 'rewriter' as engine, 'ZH' as direction, a as output, length(a) as length from c
union all select item_id, 2, 'rewriter', 'ZH > JA', b, length(b) from c
union all select item_id, 3, 'translator A', 'JA > FI', c, length(c) from c
union all select item_id, 4, 'translator B', 'FI > EN', d, length(d) from c""",
    "chat_messages": """select conv_id, turn, 0 as pos, 'system' as role, 'Be brief.' as content from conversations
union all select conv_id, turn, 1, 'user', case when turn > 0 then role else text end from conversations
union all select conv_id, turn, 2, 'assistant', text from conversations where turn > 0
union all select conv_id, turn, 3, 'user', text from conversations where turn > 0""",
    "segments_join": f"select doc_id, array_to_string({sql_sentences('text')}, '') as result from documents",
    "translation_response": "select item_id, text as result from benchmark",
    "chat_request": "select conv_id, turn, cast(to_json({'model': 'chat', 'messages': [{'role': 'system', 'content': 'Be brief.'}, {'role': 'user', 'content': text}], 'temperature': 1.3::double, 'top_p': 0.9::double}) as varchar) as body from conversations",
    "rewrite_call": r"select item_id, '2 ' || regexp_replace(text, '\s+$', '') as first, '4 2 ' || regexp_replace(text, '\s+$', '') as second from benchmark",
    "model_perplexity": "select doc_id, round(greatest(0.0::double, least(1.0::double, 1 - (length(text) % 150 - 10)::double / 100)), 9) as score from documents",
    "response_bodies": """select doc_id, cast(to_json({'result': n_chars, 'processing_time_ms': n_chars * 125, 'headers': {'HTTP-Referer': source}}) as varchar) as body from documents""",
    "feedback_loop_default": f"""with {_sql_steps(None)}, {_sql_rhythm('t30', 'item_id', 't')},
done as (select src.id as item_id, coalesce(joined.y, src.text) as t from src left join joined using (id)),
parts as (select item_id, t, unnest({sql_sentences('t')}) as x, generate_subscripts({sql_sentences('t')}, 1) as pos from done),
hits as (select *, {_sql_natural('x')} > 0.5 as hit from parts)
select item_id, case when bool_or(hit) then string_agg(case when hit then {_sql_lexicon('x')} else x end, ' ' order by pos) else any_value(t) end as result from hits group by item_id""",
    "lang_map": "select doc_id, case when doc_id % 7 = 0 then 'xx' else lang end as code from documents",
    "url_normalise": r"select page_id, case when ends_with(regexp_replace(url, '/+$', ''), '/chat/completions') then regexp_replace(url, '/+$', '') else regexp_replace(url, '/+$', '') || '/chat/completions' end as url from pages",
}
