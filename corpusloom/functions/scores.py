"""Scores of writing as columns: vocabulary, sentence lengths, naturalness, and the scale of detectors.

Moments are summed as integers and divided once, so results don't depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, sentences, words, words_of_trimmed

#: Centre and width of each signal's scale.
SCALE = {"ttr": (0.7, 0.3), "cv": (0.5, 0.3), "hapax": (0.6, 0.3)}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rescale(x: Column, centre: float, width: float) -> Column:
    return clamp((F.lit(centre) - x) / width)


def distinct_lower(w: Column) -> Column:
    return F.size(F.array_distinct(F.transform(w, F.lower)))


def type_token_ratio(w: Column) -> Column:
    """Distinct words in any case over words; null where there are none."""
    return F.when(F.size(w) > 0, distinct_lower(w) / F.size(w))


def moments(numbers: Column) -> Column:
    """n, sum and sum of squares of an integer array, in one pass."""
    zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in "nsq"))
    step = lambda acc, x: F.struct((acc["n"] + 1).alias("n"), (acc["s"] + x).alias("s"), (acc["q"] + x.cast("long") * x).alias("q"))
    return F.aggregate(numbers, zero, step)


def mean(m: Column) -> Column:
    return F.when(m["n"] > 0, m["s"] / m["n"])


def variance(m: Column) -> Column:
    """Population variance from exact moments."""
    return F.when(m["n"] > 0, (m["n"] * m["q"] - m["s"] * m["s"]) / (m["n"] * m["n"]))


def variation(m: Column) -> Column:
    """Standard deviation over mean; 0 where the mean is 0."""
    return F.when(mean(m) > 0, F.sqrt(variance(m)) / mean(m)).otherwise(0.0)


#: In sorted words, one per line: a word that stands two times or more.
_REPEATED = r"(?<![^\n])([^\n]++)(?:\n\1(?![^\n]))++"


def repeated_types(w: Column) -> Column:
    """How many distinct words occur twice or more: runs of equal lines among the sorted words.

    One sort and one scan by the regular-expression engine; a fold over words would build a struct for each.
    """
    return F.regexp_count(F.array_join(F.sort_array(w), "\n"), F.lit(_REPEATED))


def histogram(text: Column) -> Column:
    """word and n for each distinct word of a text, in lower case: counted inside the row, without a shuffle."""
    runs = lambda w: F.regexp_extract_all(F.array_join(F.sort_array(w), "\n"), F.lit(_REPEATED[:-2] + "*+"), F.lit(0))
    word = lambda x: F.substring_index(x, "\n", 1)
    counted = lambda x: let(word(x), lambda y: F.struct(y.alias("word"), F.floor((F.length(x) + 1) / (F.length(y) + 1)).cast("long").alias("n")))
    return F.transform(runs(words(F.lower(text))), counted)


def hapax_ratio(w: Column) -> Column:
    """Words seen once over distinct words, in any case."""
    return let(F.transform(w, F.lower), lambda x: let(F.size(F.array_distinct(x)), lambda n: F.when(n > 0, (n - repeated_types(x)) / n).otherwise(0.0)))


def stylometry(text: Column) -> Column:
    """n_sentences, n_words, ttr, mean_len, cv, hapax_ratio, stat_score of a text.

    The score is the mean of the three rescaled signals, and 0.5 for texts of under two sentences or no words.
    """
    def of(x: Column) -> Column:
        m, n = x["m"], x["words"]
        ttr, hapax = x["types"] / n, F.when(x["types"] > 0, (x["types"] - x["repeated"]) / x["types"]).otherwise(0.0)
        return F.struct(
            m["n"].cast("int").alias("n_sentences"), n.alias("n_words"), F.when(n > 0, ttr).alias("ttr"), mean(m).alias("mean_len"),
            variation(m).alias("cv"), hapax.alias("hapax_ratio"),
            F.when((m["n"] < 2) | (n == 0), 0.5).otherwise(
                (rescale(ttr, *SCALE["ttr"]) + rescale(variation(m), *SCALE["cv"]) + rescale(hapax, *SCALE["hapax"])) / 3).alias("stat_score"))

    def counted(lengths: Column, w: Column) -> Column:
        return F.struct(moments(lengths).alias("m"), F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("types"), repeated_types(w).alias("repeated"))

    # A text is split once: its words are those of its sentences.
    pieces = F.transform(sentences(F.lower(text)), words_of_trimmed)
    return F.when(text.isNotNull(), let(pieces, lambda p: let(F.flatten(p), lambda w: let(counted(F.transform(p, F.size), w), of))))


def naturalness(text: Column) -> Column:
    """0.6 of the case-sensitive type-token ratio plus the variance of word lengths over 10, at most 0.4."""
    counted = lambda w: F.struct(F.size(F.array_distinct(w)).alias("types"), moments(F.transform(w, F.length)).alias("m"))
    score = lambda x: F.when(x["m"]["n"] == 0, 0.0).otherwise(0.6 * (x["types"] / x["m"]["n"]) + F.least(variance(x["m"]) / 10, F.lit(0.4)))
    return F.when(text.isNotNull(), let(words(text), lambda w: let(counted(w), score)))


def perplexity_score(perplexity: Column) -> Column:
    """1 at a perplexity of 10 and less, 0 at 110 and more."""
    return clamp(1 - (perplexity - 10) / 100)


def loss_score(loss: Column) -> Column:
    return perplexity_score(F.exp(loss))


def label_score(label: Column, score: Column) -> Column:
    """The score of the machine-written class, whichever label came first."""
    return F.when(label.isin("LABEL_1", "Fake"), score).otherwise(1 - score)


def ensemble(*scores: Column) -> Column:
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return total / len(scores)
