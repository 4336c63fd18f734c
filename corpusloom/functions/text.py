"""Text as columns: white space, segmentation, words, lexicon replacement, rhythm merge, chunk packing.

Every function is built of Spark's own expressions, keeps a document in its row and works in streams.  Null
text gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (?U) makes \s Unicode white space; the four separators that follow are white space to str.split() as well.
SPACE = r"[\s\x1C-\x1F]"
_RUN = f"(?U){SPACE}+"
CHUNK_LIMIT = 4500
SHORT_WORDS = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The characters of SPACE: white space of Unicode and the four separators.
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Without white space at both ends; only the ends are looked at."""
    return F.btrim(text, F.lit(_WHITE))


def words(text: Column) -> Column:
    """White-space separated words, punctuation attached."""
    return _pieces(text, _RUN)


def _pieces(text: Column, pattern: str) -> Column:
    """The trimmed text split at white space: no piece is empty, so none need be filtered or trimmed."""
    return let(strip(text), lambda t: F.when(t.isNull(), None).when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, pattern)))


def words_of_trimmed(text: Column) -> Column:
    """Words of a text that is trimmed and not empty, such as a sentence."""
    return F.split(text, _RUN)


def drop_empty(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Split at white space after ``.``, ``!`` or ``?``; trimmed, empty ones dropped."""
    return _pieces(text, f"(?U)(?<=[.!?]){SPACE}+")


def sentences_cjk(text: Column) -> Column:
    """As :func:`sentences`, also after full-width marks; neither trimmed nor filtered."""
    return F.split(text, f"(?U)(?<=[.!?。！？]){SPACE}+", -1)


def join_sentences(items: Column) -> Column:
    return F.array_join(items, " ")


def pack_chunks(text: Column, max_len: int = CHUNK_LIMIT) -> Column:
    """Greedy chunks of whole sentences: a sentence that doesn't fit opens a new one; a longer one stays whole.
    """
    kind = "array<string>"

    def step(acc: Column, s: Column) -> Column:
        size = F.length(s)
        full = acc["size"] + size + 1 > max_len
        opened = F.struct(
            F.when(acc["size"] > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            s.alias("cur"),
            size.alias("size"),
        )
        longer = strip(F.concat(acc["cur"], F.lit(" "), s))
        kept = let(longer, lambda c: F.struct(acc["done"].alias("done"), c.alias("cur"), F.length(c).alias("size")))
        return F.when(full, opened).otherwise(kept)

    zero = F.struct(F.array().cast(kind).alias("done"), F.lit("").alias("cur"), F.lit(0).alias("size"))
    finish = lambda acc: F.when(acc["size"] > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
    packed = F.aggregate(sentences_cjk(text), zero, step, finish)
    return let(packed, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(text)))


def chunk_map(text: Column, engine: Callable[[Column], Column], max_len: int = CHUNK_LIMIT) -> Column:
    """Apply ``engine`` to a text, by chunks joined with a space where it is longer than ``max_len``."""
    long = lambda t: F.array_join(F.transform(pack_chunks(t, max_len), lambda c: engine(c)), " ")
    return let(text, lambda t: F.when(F.length(t) > max_len, long(t)).otherwise(engine(t)))


# The default lexicon, 30 words with three alternatives each.
LEXICON: dict[str, tuple[str, str, str]] = {
    "utilize": ("use", "apply", "work with"),
    "facilitate": ("help", "support", "enable"),
    "comprehensive": ("full", "complete", "thorough"),
    "subsequently": ("then", "after that", "next"),
    "furthermore": ("also", "plus", "on top of that"),
    "demonstrate": ("show", "prove", "illustrate"),
    "implement": ("build", "set up", "put in place"),
    "leverage": ("use", "take advantage of", "tap into"),
    "optimize": ("improve", "fine-tune", "make better"),
    "paradigm": ("model", "approach", "framework"),
    "synergy": ("teamwork", "combined effect", "collaboration"),
    "methodology": ("method", "approach", "process"),
    "innovative": ("new", "creative", "fresh"),
    "streamline": ("simplify", "speed up", "smooth out"),
    "unprecedented": ("never seen before", "unheard of", "groundbreaking"),
    "transformative": ("game-changing", "revolutionary", "major"),
    "ecosystem": ("environment", "landscape", "space"),
    "scalable": ("flexible", "expandable", "growable"),
    "robust": ("strong", "solid", "reliable"),
    "cutting-edge": ("latest", "advanced", "modern"),
    "delve": ("dig into", "explore", "look at"),
    "intricate": ("complex", "detailed", "involved"),
    "pivotal": ("key", "crucial", "central"),
    "encompasses": ("includes", "covers", "spans"),
    "multifaceted": ("complex", "varied", "diverse"),
    "realm": ("area", "field", "world"),
    "commendable": ("impressive", "notable", "praiseworthy"),
    "meticulous": ("careful", "thorough", "precise"),
    "paramount": ("essential", "critical", "top priority"),
    "underscore": ("highlight", "stress", "emphasize"),
}

Choice = Callable[[Column, Column], Column]


def choose_first(rank: Column, options: Column) -> Column:
    return F.get(options, F.lit(0))


def choose_by(key: Column) -> Choice:
    """Pick by ``key + rank`` modulo the number of options: as spread as a random pick, and repeatable."""
    return lambda rank, options: F.get(options, F.pmod(key + rank, F.size(options)).cast("int"))


def choose_random(key: Column, seed: int) -> Choice:
    """Pick by a seeded hash of the row's key."""
    return lambda rank, options: F.get(options, F.pmod(F.xxhash64(key, F.lit(seed), rank), F.size(options)).cast("int"))


def replace_lexicon(text: Column, lexicon: Mapping[str, Sequence[str]] | None = None, choose: Choice = choose_first) -> Column:
    """For each word in order, replace its first occurrence, in any case and also inside other words.

    The match is made on the text itself, so letters whose lower case is longer move nothing.  The folded text
    only tells where to look: without a word in it (and a letter that folds to two) nothing can match.
    """
    def entry(rank: int, word: str, options: Sequence[str]) -> Column:
        quoted = word.replace("\\E", "\\E\\\\E\\Q")
        return F.struct(F.lit(rank).alias("rank"), F.lit(word.lower()).alias("word"), F.lit(rf"(?ius)\A(.*?)\Q{quoted}\E").alias("pattern"), F.array(*map(F.lit, options)).alias("options"))

    def step(t: Column, x: Column) -> Column:
        chosen = F.replace(F.replace(choose(x["rank"], x["options"]), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))  # no group references
        may = F.contains(F.lower(F.upper(t)), x["word"]) | F.contains(t, F.lit("İ"))
        return F.when(may, F.regexp_replace(t, x["pattern"], F.concat(F.lit("$1"), chosen))).otherwise(t)

    entries = [entry(rank, word, options) for rank, (word, options) in enumerate((lexicon or LEXICON).items())]
    return F.aggregate(F.array(*entries), text, step)


def merge_rhythm(text: Column, short: int = SHORT_WORDS) -> Column:
    """Join neighbouring short sentences in pairs with a dash; texts of under three sentences stay as they are."""
    item = "array<string>"

    def dash(a: Column, b: Column) -> Column:
        return F.concat(F.regexp_replace(a, "[.!?]+$", ""), F.lit(" — "), F.lower(F.substr(b, F.lit(1), F.lit(1))), F.substr(b, F.lit(2)))

    def step(acc: Column, s: Column) -> Column:
        brief = F.size(words_of_trimmed(s)) < short
        waits = acc["wait"].isNotNull()
        flushed = F.when(waits, F.concat(acc["out"], F.array(acc["wait"]))).otherwise(acc["out"])
        joined = F.struct(F.concat(acc["out"], F.array(dash(acc["wait"], s))).alias("out"), F.lit(None).cast("string").alias("wait"))
        held = F.struct(acc["out"].alias("out"), s.alias("wait"))
        plain = F.struct(F.concat(flushed, F.array(s)).alias("out"), F.lit(None).cast("string").alias("wait"))
        return F.when(brief & waits, joined).when(brief, held).otherwise(plain)

    zero = F.struct(F.array().cast(item).alias("out"), F.lit(None).cast("string").alias("wait"))
    finish = lambda acc: F.when(acc["wait"].isNotNull(), F.concat(acc["out"], F.array(acc["wait"]))).otherwise(acc["out"])
    merged = lambda t, s: F.when(F.size(s) < 3, t).otherwise(F.array_join(F.aggregate(s, zero, step, finish), " "))
    return let(text, lambda t: let(sentences(t), lambda s: merged(t, s)))


def postprocess(text: Column, replace_vocabulary: bool = True, disrupt_rhythm: bool = True, short: int = SHORT_WORDS, lexicon=None, choose: Choice = choose_first) -> Column:
    if replace_vocabulary:
        text = replace_lexicon(text, lexicon, choose)
    return merge_rhythm(text, short) if disrupt_rhythm else text


def lang_code(code: Column, table: Mapping[str, str] | None = None) -> Column:
    """Look a language code up; unknown ones pass through."""
    table = LANG_CODES if table is None else table
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, code), code)


#: Codes that the second translation engine shares with the first.
LANG_CODES = {c: c for c in ("en", "zh", "ja", "ko", "de", "fr", "es", "fi", "it", "pt", "ru", "ar", "nl")}


def completions_url(base: Column) -> Column:
    """Strip trailing slashes and add the endpoint unless it is there."""
    bare = F.regexp_replace(base, "/+$", "")
    return F.when(bare.endswith("/chat/completions"), bare).otherwise(F.concat(bare, F.lit("/chat/completions")))


def chat_messages(system: Column, text: Column, history: Column | None = None) -> Column:
    """System message, one earlier turn where ``history`` (input, output) is not null, then the text."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    plain = F.array(one("system", system), one("user", text))
    if history is None:
        return plain
    full = F.array(one("system", system), one("user", history["input"]), one("assistant", history["output"]), one("user", text))
    return F.when(history.isNotNull(), full).otherwise(plain)


def request_json(model: str, messages: Column, temperature: float, top_p: float | None = None) -> Column:
    fields = [F.lit(model).alias("model"), messages.alias("messages"), F.lit(temperature).alias("temperature")]
    return F.to_json(F.struct(*fields, *([F.lit(top_p).alias("top_p")] if top_p is not None else [])))


def completion_text(body: Column) -> Column:
    """The trimmed content of the first choice of a chat response."""
    return strip(F.get_json_object(body, "$.choices[0].message.content"))


def translation_text(body: Column) -> Column:
    """The target text of a translation response; its error message, or an unknown response, stops the job."""
    got = F.from_json(body, "tgt_text string, error_msg string")
    return F.coalesce(got["tgt_text"], F.raise_error(F.concat(F.lit("translation failed: "), F.coalesce(got["error_msg"], body))).cast("string"))


def segments_text(body: Column) -> Column:
    """Concatenate the first item of each entry of the first list of a nested JSON list."""
    rows = F.from_json(body, "array<array<array<string>>>")
    return F.array_join(F.transform(F.get(rows, F.lit(0)), lambda x: F.get(x, F.lit(0))), "")


def header_map(**headers: Column) -> Column:
    """A map of the headers that are set and not empty, or null."""
    pairs = F.create_map(*(x for k, v in headers.items() for x in (F.lit(k.replace("_", "-")), v)))
    kept = F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, kept)


def checked_completion(body: Column) -> Column:
    """:func:`completion_text`; a response without one stops the job."""
    got = completion_text(body)
    return F.coalesce(got, F.raise_error(F.concat(F.lit("no completion in response: "), F.coalesce(body, F.lit("none")))).cast("string"))


def whole_milliseconds(seconds: Column) -> Column:
    return (seconds * 1000).cast("long")
