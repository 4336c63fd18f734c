r"""Chat formatting by a grammar round trip, in DataFrame functions only.

A conversation becomes one string::

    #chat 0
    ### user: Hello</turn>
    ### assistant: Hi</turn>

The digit is the escape level.  Every conversation is first rendered at level 0, with its texts as they
are, and read again by :func:`parse`.  Where the recovered turns differ from the source, because a text or
role holds a control string, the conversation is rendered at level 1, where control strings and the escape
character are escaped, and read once more.  A conversation that differs even then stops the job.

Defined results: null text or role is empty; rows are ordered by turn (null first), then role, then text, so
repeated rows and ties stay, in a fixed order; null ``conv_id`` is one conversation of its own; an empty
table gives no rows; columns other than the four named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, CLOSE, ESCAPE = "###", "</turn>", "\\"
_TURNS = "array<struct<role:string,text:string>>"


def escape(x: Column) -> Column:
    r"""``\`` to ``\\``, ``###`` to ``\h``, ``</turn>`` to ``\l``, ``:`` stays."""
    x = F.replace(x, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.replace(F.replace(x, F.lit(OPEN), F.lit(r"\h")), F.lit(CLOSE), F.lit(r"\l"))


def unescape(x: Column) -> Column:
    """The inverse of :func:`escape`: a doubled escape character ends no other escape, as scanning is from the left."""
    parts = F.split(x, r"\\\\", -1)
    back = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit(r"\l"), F.lit(CLOSE)), F.lit(r"\h"), F.lit(OPEN)), F.lit(r"\c"), F.lit(":")))
    return F.array_join(back, ESCAPE)


def render(turns: Column, level: int) -> Column:
    role = (lambda r: F.replace(escape(r), F.lit(":"), F.lit(r"\c"))) if level else (lambda r: r)
    text = escape if level else (lambda t: t)
    body = F.transform(turns, lambda t: F.concat(F.lit(f"{OPEN} "), role(t["role"]), F.lit(": "), text(t["text"]), F.lit(f"{CLOSE}\n")))
    return F.concat(F.lit(f"#chat {level}\n"), F.array_join(body, ""))


def parse(formatted: Column) -> Column:
    """The turns that a formatted conversation holds, or null where it breaks the grammar.

    Grammar: a header, then pieces that each open with ``###`` and close with the piece's only ``</turn>``.
    """

    def piece(p: Column, level: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(2)), ": ", 1)
        inner = F.substr(p, F.length(role) + 4, F.length(p) - F.length(role) - 3 - len(CLOSE) - 1)
        ok = p.startswith(" ") & p.endswith(f"{CLOSE}\n") & p.contains(": ") & (F.length(F.replace(p, F.lit(CLOSE), F.lit(""))) == F.length(p) - len(CLOSE))
        raw = F.struct(role.alias("role"), inner.alias("text"))
        plain = F.struct(unescape(role).alias("role"), unescape(inner).alias("text"))
        return F.when(ok, F.when(level == "1", plain).otherwise(raw))

    def pieces(all_: Column) -> Column:
        level = F.substr(formatted, F.lit(7), F.lit(1))
        return F.transform(F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0))), lambda p: piece(p, level))

    body = F.split(F.substr(formatted, F.lit(9)), OPEN, -1)
    return let(body, lambda b: F.when(F.get(b, F.lit(0)) == "", let(pieces(b), lambda t: F.when(~F.exists(t, lambda x: x.isNull()), t))))


def loss_spans(turns: Column, level: Column, role: str) -> Column:
    """Spans (start, end; code points, end exclusive) of the texts of ``role`` in the formatted string."""
    deep = level == 1
    role_len = lambda t: F.when(deep, F.length(F.replace(escape(t["role"]), F.lit(":"), F.lit(r"\c")))).otherwise(F.length(t["role"]))
    text_len = lambda t: F.when(deep, F.length(escape(t["text"]))).otherwise(F.length(t["text"]))
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(OPEN) + 3 + role_len(t)
        end = start + text_len(t)
        span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct((end + len(CLOSE) + 1).cast("int").alias("at"), F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(8).cast("int").alias("at"), F.array().cast(kind).alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, escape_level, loss_spans.

    A conversation is one string in the output, so its turns meet in one row; nothing else is gathered.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("sorted"))
    turns = grouped.select("conv_id", F.transform("sorted", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    first = turns.withColumn("plain", render(F.col("turns"), 0))
    level = F.when(F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)), 0).otherwise(1)
    tried = first.withColumn("escape_level", level)
    chosen = tried.withColumn("formatted", F.when(F.col("escape_level") == 0, F.col("plain")).otherwise(render(F.col("turns"), 1)))
    same = (F.col("escape_level") == 0) | F.coalesce(parse(F.col("formatted")) == F.col("turns"), F.lit(False))
    return chosen.select(
        "conv_id",
        F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))).alias("formatted"),
        "escape_level",
        loss_spans(F.col("turns"), F.col("escape_level"), loss_role).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns and loss_text, all recovered from the formatted strings alone and their spans."""
    def masked(span: Column) -> Column:
        raw = F.substr("formatted", span["start"] + 1, span["end"] - span["start"])
        return F.when(F.col("escape_level") == 1, unescape(raw)).otherwise(raw)

    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(F.transform("loss_spans", masked), "").alias("loss_text"))
