"""Edge cases of the row-wise functions on literal texts, against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scores
from corpusloom.functions import text as T
from corpusloom.operators import config, engines, methods

TEXTS = [
    "", "   ", "One.", "No marks at all", "a b.  c d! e", "Hi there. Go on. Yes. This one has quite a lot more words in it. No.",
    "Short one. Another short! Third? This sentence is long enough not to count as short. Tiny.\nEnd.", "Utilize it. We utilize THIS. Robust utilization.",
    "日本。 語です。次！ 終わり", "İstanbul is. big. ONE one One.",
]


def column(spark, expr, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    return [r[0] for r in df.select("id", expr.alias("x")).orderBy("id").select("x").collect()]


def py_sentences(t):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]


def py_score(t):
    s, w = py_sentences(t), t.split()
    if len(s) < 2 or not w:
        return 0.5
    low = [x.lower() for x in w]
    n = [len(x.split()) for x in s]
    m = sum(n) / len(n)
    cv = math.sqrt(sum((x - m) ** 2 for x in n) / len(n)) / m
    once = sum(low.count(x) == 1 for x in set(low)) / len(set(low))
    part = lambda a, b, x: max(0, min(1, (a - x) / b))
    return (part(0.7, 0.3, len(set(low)) / len(w)) + part(0.5, 0.3, cv) + part(0.6, 0.3, once)) / 3


def py_rhythm(t, short=8):
    s, out, i = py_sentences(t), [], 0
    if len(s) < 3:
        return t
    brief = [len(x.split()) < short for x in s]
    while i < len(s):
        if i + 1 < len(s) and brief[i] and brief[i + 1]:
            out.append(f"{s[i].rstrip('.!?')} — {s[i + 1][0].lower()}{s[i + 1][1:]}")
            i += 2
        else:
            out.append(s[i])
            i += 1
    return " ".join(out)


def py_chunks(t, n):
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?。！？])\s+", t):
        if len(cur) + len(s) + 1 > n:
            if cur:
                out.append(cur)
            cur = s
        else:
            cur = f"{cur} {s}".strip()
    return out + [cur] if cur else out or [t]


def test_sentences_and_words(spark):
    assert column(spark, T.sentences(F.col("text")))[:-1] == [py_sentences(t) for t in TEXTS]
    assert column(spark, T.words(F.col("text")))[:-1] == [t.split() for t in TEXTS]
    assert column(spark, T.sentences(F.col("text")))[-1] is None


def test_scores(spark):
    got = column(spark, scores.stylometry(F.col("text"))["stat_score"])
    assert got[:-1] == pytest.approx([py_score(t) for t in TEXTS]) and got[-1] is None
    assert column(spark, scores.naturalness(F.col("text")))[0] == 0.0


def test_rhythm(spark):
    assert column(spark, T.merge_rhythm(F.col("text")))[:-1] == [py_rhythm(t) for t in TEXTS]


@pytest.mark.parametrize("limit", [5, 12, 40])
def test_chunks(spark, limit):
    assert column(spark, T.pack_chunks(F.col("text"), limit))[:-1] == [py_chunks(t, limit) for t in TEXTS]


def test_chunks_of_repeated_sentence(spark):
    long = "This is a sentence here. " * 200
    (chunks, short, _) = column(spark, T.pack_chunks(F.col("text"), 1000), [long, "Hello there."])
    assert len(chunks) > 1 and max(map(len, chunks)) <= 1100 and short == ["Hello there."]


def test_lexicon(spark):
    got = column(spark, T.replace_lexicon(F.col("text")))
    assert got[7] == "use it. We utilize THIS. strong utilization." and got[-1] is None
    assert len(T.LEXICON) == 30 and all(len(v) == 3 for v in T.LEXICON.values())
    picks = column(spark, T.replace_lexicon(F.col("text"), choose=T.choose_random(F.col("id"), 3)))
    assert picks == column(spark, T.replace_lexicon(F.col("text"), choose=T.choose_random(F.col("id"), 3)))


def test_json_and_urls(spark):
    body = '{"choices":[{"message":{"content":"  hi \\n"}}]}'
    assert column(spark, T.completion_text(F.col("text")), [body])[0] == "hi"
    assert column(spark, T.segments_text(F.col("text")), ['[[["a","x"],["b","y"]]]'])[0] == "ab"
    urls = ["https://h/v1", "https://h/v1/", "https://h/v1/chat/completions"]
    assert column(spark, T.completions_url(F.col("text")), urls)[:3] == ["https://h/v1/chat/completions"] * 3
    assert column(spark, T.lang_code(F.col("text")), ["en", "zh", "fi", "xx"])[:4] == ["en", "zh", "fi", "xx"]


def test_translation_error(spark):
    df = spark.createDataFrame([('{"error_msg":"quota"}',)], "text string")
    with pytest.raises(Exception, match="quota"):
        df.select(T.translation_text(F.col("text"))).collect()


def test_methods(spark):
    df = spark.createDataFrame([(1, "One two. Three four! Five."), (2, "")], "doc_id int, text string")
    assert sorted(methods.METHODS) == ["detection_guided", "llm_rewrite", "mixed_engine", "translation_chain"]
    with pytest.raises(ValueError):
        methods.run_method(df, "other")
    with pytest.raises(KeyError):
        methods.run_method(df)
    with pytest.raises(ValueError):
        engines.pick("other")
    assert methods.hops("focus") == methods.hops("advanced") and len(methods.hops("standard")) == 3 == len(methods.hops("unknown"))
    none = methods.best_of(df, {"a": engines.failing, "b": engines.failing}, ("a", "b")).orderBy("doc_id").collect()
    assert none[0]["result"] == "One two. Three four! Five."
    tied = methods.best_of(df, {"a": lambda t, s, g: F.concat(t, F.lit("")), "b": engines.upper}, ("a", "b")).orderBy("doc_id").first()
    assert tied["result"] == "One two. Three four! Five."
    same = methods.scored_loop(df, lambda s: F.lit(0.5), lambda s: F.upper(s), first=lambda t: t).orderBy("doc_id").first()
    assert same["result"] == "One two. Three four! Five."
    trace = methods.standard_chain(df).where("doc_id = 1").first()
    assert [s["step"] for s in trace["steps"]] == [1, 2, 3, 4] and trace["result"] == trace["steps"][3]["output"]


def test_remote_engine(spark):
    df = spark.createDataFrame([(1, "ab. " * 10), (2, "x")], "doc_id int, text string")
    shout = engines.remote(lambda source, target: lambda batch: [None if t is None else f"{source}{t.upper()}" for t in batch])
    got = methods.chunk_map_rows(df, lambda c: shout(c, "<", "en"), limit=20).orderBy("doc_id").collect()
    assert got[1]["result"] == "<X" and got[0]["result"].count("<") == 2
    twice = df.union(df).unionByName(spark.createDataFrame([(None, "y"), (None, "y")], df.schema))
    again = methods.chunk_map_rows(twice, lambda c: shout(c, "<", "en"), limit=20)
    assert again.columns == ["doc_id", "text", "result"] and sorted(r["result"] for r in again.collect()) == sorted([got[0]["result"], "<X"] * 2 + ["<Y"] * 2)


def test_config():
    keys = {"api_keys": {"primary_api_key": "k", "secondary_api_key": "s"}}
    got = config.resolve(keys, {})
    assert (got.provider, got.temperature, got.api_key, got.extra_headers) == ("primary", 1.3, "k", None)
    assert config.resolve({**keys, "llm": {"provider": "secondary"}}, {}).api_key == "s"
    assert config.resolve({**keys, "llm": {"base_url": "u", "model": "m", "temperature": 0.2}, "pipeline": {"model": "p", "temperature": 1}}, {}).model == "m"
    assert config.resolve({**keys, "pipeline": {"model": "p"}}, {"LLM_MODEL": "e", "LLM_API_KEY": "g", "LLM_BASE_URL": "b"}).model == "e"
    assert config.resolve({**keys, "llm": {"app_title": "t"}}, {}).extra_headers == {"X-Title": "t"}
    assert "k" not in repr(got).replace("api_key", "").split("provider=")[0]
    with pytest.raises(ValueError):
        config.resolve({}, {})
    with pytest.raises(ValueError):
        config.resolve({**keys, "llm": {"provider": "none"}}, {})


def test_lexicon_matches_the_text_itself(spark):
    one = spark.createDataFrame([("İİ utilize it",), ("İ UTILIZE\nutilize",), (None,), ("",)], "text string")
    assert [r[0] for r in one.select(T.replace_lexicon(F.col("text"))).collect()] == ["İİ use it", "İ use\nutilize", None, ""]
    odd = {"a.b": ("$1\\x",)}
    assert spark.createDataFrame([("axb A.B",)], "text string").select(T.replace_lexicon(F.col("text"), odd)).first()[0] == "axb $1\\x"


def test_engines_end_to_end(spark):
    import json

    from corpusloom.operators import engines

    df = spark.createDataFrame(spark.sparkContext.parallelize([("hello", "a", "b")]), "text string, a string, b string")
    seen = engines.chat_rewriter(lambda: lambda bodies: [json.dumps({"choices": [{"message": {"content": b}}]}) for b in bodies], "sys", "m", 0.5)
    body = json.loads(df.select(seen(F.col("text"), F.struct(F.col("a").alias("input"), F.col("b").alias("output"))).alias("x")).first()[0])
    assert body == {"model": "m", "messages": [{"role": r, "content": c} for r, c in (("system", "sys"), ("user", "a"), ("assistant", "b"), ("user", "hello"))], "temperature": 0.5}
    failing = engines.chat_rewriter(lambda: lambda bodies: ["{}" for _ in bodies], "sys", "m")
    with pytest.raises(Exception, match="no completion"):
        df.select(failing(F.col("text")).alias("x")).collect()
    assert df.select(engines.scorer(lambda: lambda texts: [len(t) for t in texts])(F.col("text"))).first()[0] == 5.0


def test_config_file(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[llm]\nprovider = "secondary"\n[api_keys]\nsecondary_api_key = "k"\n')
    from corpusloom.operators import config

    got = config.resolve(config.load_config(str(path)), env={})
    assert (got.provider, got.api_key) == ("secondary", "k")
    assert config.resolve({}, env={"SECONDARY_API_KEY": "x", "LLM_PROVIDER": "secondary"}).api_key == "x"
    with pytest.raises(ValueError, match="Unsupported LLM provider"):
        config.resolve({}, env={"LLM_PROVIDER": "other", "LLM_API_KEY": "x"})


def test_stdout_and_time(spark, capsys):
    from corpusloom.operators import methods
    from corpusloom.sources import texts

    texts.write_stdout(spark.createDataFrame([("a",), (None,)], "result string").coalesce(1))
    assert capsys.readouterr().out == "a\n\n"
    got, seconds = methods.timed(lambda: 7)
    assert got == 7 and seconds >= 0
