"""Methods over documents: chains of engines, rounds, the scored loop, best of several engines, dispatch.

Each takes a DataFrame with a ``text`` column and returns it with ``result`` (and ``steps`` for the standard
chain).  Chains are unrolled while the plan is built; engines are parameters.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from .engines import STAND_INS, Engine, pick

#: Hops of each tier; the last goes back to the first language.
TIERS = {"standard": 3, "advanced": 4, "focus": 5}
CHAIN = ("zh-CN", "ja", "fi")
ENGINES = ("google", "mymemory")


def hops(tier: str, chain: Sequence[str] = CHAIN, engines: Sequence[str] = ENGINES, home: str = "en") -> list[tuple[str, str, str]]:
    """(engine, source, target) of each hop; an unknown tier is the standard one."""
    languages = list(chain[: TIERS.get(tier, 3) - 1])
    sources = [home, *languages]
    out = [(engines[i % len(engines)], sources[i], lang) for i, lang in enumerate(languages)]
    return [*out, (engines[0], sources[-1], home)]


def translation_chain(df: DataFrame, tier: str = "standard", registry: dict[str, Engine] | None = None, chain=CHAIN, engines=ENGINES, limit: int = T.CHUNK_LIMIT, **_) -> DataFrame:
    df = df.withColumn("result", F.col("text"))
    for name, source, target in hops(tier, chain, engines):
        engine = pick(name, registry)
        df = df.withColumn("result", T.chunk_map(F.col("result"), lambda x, e=engine, s=source, t=target: e(x, s, t), limit) if limit else engine(F.col("result"), source, target))
    return df


def chunk_map_rows(df: DataFrame, engine: Callable[[Column], Column], limit: int = T.CHUNK_LIMIT, key: str = "doc_id") -> DataFrame:
    """Chunk map for remote engines, which can't run inside an array: one row per chunk, put together by position.

    The shuffle carries one text in total per document.  Rows are told apart by their number in the plan, so a
    repeated or null ``key`` keeps its rows, and a row travels whole beside its chunks.
    """
    chunks = F.when(F.length("text") > limit, T.pack_chunks(F.col("text"), limit)).otherwise(F.array("text"))
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")
    numbered = df.select(F.monotonically_increasing_id().alias("__n"), whole, chunks.alias("__chunks"))
    numbered = numbered.select("__n", "__row", F.posexplode("__chunks").alias("__pos", "__chunk"))
    # The row itself goes with its first chunk alone.
    rows = numbered.select("__n", F.when(F.col("__pos") == 0, F.col("__row")).alias("__row"), "__pos", engine(F.col("__chunk")).alias("__out"))
    parts = F.array_sort(F.collect_list(F.struct("__pos", "__out")))
    joined = rows.groupBy("__n").agg(F.first("__row", ignorenulls=True).alias("__row"), parts.alias("__parts"))
    return joined.select("__row.*", F.array_join(F.transform("__parts", lambda p: p["__out"]), " ").alias("result"))


def multi_round(df: DataFrame, rounds: int = 2, engines: Sequence[Callable[[Column], Column]] | None = None, **_) -> DataFrame:
    """Round i applies engine i, for at most as many rounds as there are engines."""
    engines = engines or [lambda t, i=i: F.concat(F.lit(f"(round {i}) "), t) for i in (1, 2, 3)]
    df = df.withColumn("result", F.col("text"))
    for engine in engines[: min(rounds, len(engines))]:
        df = df.withColumn("result", engine(F.col("result")))
    return df


def flagged(items: Column, score: Callable[[Column], Column], threshold: float = 0.5) -> Column:
    """Positions whose score is above the threshold."""
    marked = F.transform(items, lambda s, i: F.when(score(s) > threshold, i))
    return F.filter(marked, lambda i: i.isNotNull())


def scored_loop(df: DataFrame, score: Callable[[Column], Column] | None = None, rewrite: Callable[[Column], Column] | None = None, rounds: int = 2, threshold: float = 0.5, first: Callable[[Column], Column] | None = None, **_) -> DataFrame:
    """Post-process once; then, in each round, rewrite the sentences that score above the threshold.

    Where none does the text stays as it is, byte for byte, also in later rounds, as scores repeat.
    """
    score = score or scores.naturalness
    rewrite = rewrite or T.replace_lexicon
    df = df.withColumn("result", (first or T.postprocess)(F.col("text")))
    for _ in range(rounds):
        def turn(s: Column) -> Column:
            marked = F.transform(s, lambda x: F.struct(x.alias("s"), (score(x) > threshold).alias("hit")))
            joined = lambda m: F.array_join(F.transform(m, lambda x: F.when(x["hit"], rewrite(x["s"])).otherwise(x["s"])), " ")
            return T.let(marked, lambda m: F.when(F.exists(m, lambda x: x["hit"]), joined(m)).otherwise(F.col("result")))

        df = df.withColumn("result", T.let(T.sentences(F.col("result")), turn))
    return df


def best_of(df: DataFrame, registry: dict[str, Engine] | None = None, engines: Sequence[str] = ENGINES, pivot: str = "zh-CN", home: str = "en", score: Callable[[Column], Column] = scores.naturalness, digits: int = 9, **_) -> DataFrame:
    """Each sentence goes out and back through every engine; the best score wins, the earliest engine on ties.

    An engine that gives null is passed over; a sentence that none gives stays.  Scores are rounded, so that
    ties don't hang on the last bit.
    """

    def candidates(s: Column) -> Column:
        outs = [pick(e, registry)(pick(e, registry)(s, home, pivot), pivot, home) for e in engines]
        return F.array(*(F.struct(F.round(score(o), digits).alias("score"), F.lit(-k).alias("order"), o.alias("out")) for k, o in enumerate(outs)))

    def best(s: Column) -> Column:
        kept = F.filter(candidates(s), lambda c: c["out"].isNotNull())
        return F.coalesce(F.array_max(kept)["out"], s)

    return df.withColumn("result", F.array_join(F.transform(T.sentences(F.col("text")), best), " "))


def standard_chain(df: DataFrame, rewriters: Sequence[Callable] | None = None, translators: Sequence[Engine] | None = None, target: str = "en", intermediate: str = "fi", limit: int = T.CHUNK_LIMIT, **_) -> DataFrame:
    """Two rewrites (the second with one earlier turn as its history), then two translations, with a trace.

    The first translator works by chunks, the second on whole texts.  ``steps`` has one entry per step.
    """
    rewriters = rewriters or [lambda t, h: F.concat(F.lit("[zh] "), t), lambda t, h: F.concat(F.lit("[ja] "), t)]
    translators = translators or [STAND_INS["google"], STAND_INS["mymemory"]]
    df = df.withColumn("__1", rewriters[0](F.col("text"), None))
    history = F.struct(F.col("text").alias("input"), F.col("__1").alias("output"))
    df = df.withColumn("__2", rewriters[1](F.col("__1"), history))
    df = df.withColumn("__3", T.chunk_map(F.col("__2"), lambda x: translators[0](x, "ja", intermediate), limit))
    df = df.withColumn("__4", translators[1](F.col("__3"), intermediate, target))
    names = [("rewriter", "ZH"), ("rewriter", "ZH > JA"), ("translator A", f"JA > {intermediate.upper()}"), ("translator B", f"{intermediate.upper()} > {target.upper()}")]
    steps = [F.struct(F.lit(k).alias("step"), F.lit(e).alias("engine"), F.lit(d).alias("direction"), F.col(f"__{k}").alias("output"), F.length(f"__{k}").alias("length")) for k, (e, d) in enumerate(names, 1)]
    return df.withColumns({"result": F.col("__4"), "steps": F.array(*steps)}).drop("__1", "__2", "__3", "__4")


METHODS: dict[str, Callable[..., DataFrame]] = {
    "translation_chain": translation_chain,
    "llm_rewrite": multi_round,
    "detection_guided": scored_loop,
    "mixed_engine": best_of,
}


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """The result of an action and its wall time in seconds, for sinks that report it."""
    began = time.perf_counter()
    out = action()
    return out, time.perf_counter() - began


def run_method(df: DataFrame, method: str | None = None, config: dict | None = None, **options) -> DataFrame:
    """Dispatch by name, by default the one that ``config["general"]["default_method"]`` names; adds ``method_used``."""
    method = method or (config or {})["general"]["default_method"]
    if method not in METHODS:
        raise ValueError(f"no method is named {method!r}; there are {sorted(METHODS)}")
    return METHODS[method](df, **options).withColumn("method_used", F.lit(method))
