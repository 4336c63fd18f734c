"""Engines: named functions from a text column to a text column.

A remote or model engine is a batch function wrapped by :func:`remote`; nothing here opens a connection.  The
stand-ins are plain column expressions, repeatable and offline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

Engine = Callable[[Column, str, str], Column]


def tag(name: str) -> Engine:
    """Marks a text with the engine's name and its languages."""
    return lambda text, source, target: F.concat(F.lit(f"[{name} {source}>{target}] "), text)


def upper(text: Column, source: str, target: str) -> Column:
    return F.upper(text)


def swap_case(text: Column, source: str, target: str) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def failing(text: Column, source: str, target: str) -> Column:
    """An engine that gives no result."""
    return F.when(F.lit(False), text)


#: Names of the two translation engines, here as offline stand-ins.
STAND_INS: dict[str, Engine] = {"google": tag("google"), "mymemory": tag("mymemory")}


def pick(name: str, registry: dict[str, Engine] | None = None) -> Engine:
    registry = STAND_INS if registry is None else registry
    if name not in registry:
        raise ValueError(f"Unsupported engine: {name}")
    return registry[name]


def remote(connect: Callable[[str, str], Callable[[list], list]]) -> Engine:
    """An engine of Python code, in Arrow batches: ``connect`` runs once per task and gives a batch function.

    The column is marked as non-deterministic, so that the optimizer never repeats its calls; checkpoint or
    write a chain before using it twice.
    """
    def engine(text: Column, source: str, target: str) -> Column:
        @F.pandas_udf("string")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = connect(source, target)
            for batch in batches:
                yield pd.Series(run(batch.tolist()), index=batch.index)

        return call.asNondeterministic()(text)

    return engine


def _called(connect: Callable[[], Callable[[list], list]], kind: str) -> Callable[[Column], Column]:
    def apply(column: Column) -> Column:
        @F.pandas_udf(kind)
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = connect()
            for batch in batches:
                yield pd.Series(run(batch.tolist()), index=batch.index, dtype="float64" if kind == "double" else "object")

        return call.asNondeterministic()(column)

    return apply


def scorer(connect: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    """A model as a score of texts, in Arrow batches: ``connect`` loads it once per task and gives a batch function.

    Perplexities go through :func:`scores.perplexity_score`, label probabilities through :func:`scores.label_score`.
    """
    return _called(connect, "double")


def chat_rewriter(post: Callable[[], Callable[[list], list]], system: str, model: str, temperature: float = 1.3, top_p: float | None = None) -> Callable[[Column, Column | None], Column]:
    """A rewrite call: messages (with one earlier turn as history), JSON request, batch call, first choice's content.

    ``post`` connects once per task and gives a function from request bodies to response bodies; a response
    without a completion stops the job.
    """
    send = _called(post, "string")

    def rewrite(text: Column, history: Column | None = None) -> Column:
        messages = T.chat_messages(F.lit(system), text, history)
        return T.checked_completion(send(T.request_json(model, messages, temperature, top_p)))

    return rewrite
