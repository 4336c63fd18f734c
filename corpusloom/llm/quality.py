"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Features are computed inside the row, without a shuffle.  Each rule turns them into a level of 0 to STEPS, worse
when higher.  Labels are parted by a digest of the id: six of sixteen grade the levels of all rules by the share of
bad documents at them, which gives each document one risk, its worst grade.  The other ten of sixteen are the
holdout: per stratum (language), cutoffs of the risk are tested in a fixed order, and a cutoff is certified if the
exact binomial tail shows that it falsely rejects at most ``ALPHA`` of the good documents, at level ``DELTA`` shared
over the strata (Bonferroni; the fixed order needs no further correction).  The least certified cutoff of at least
LEAST_RISK is taken.  A stratum of too few good held-out labels (under ln(DELTA / strata) / ln(1 - ALPHA), 217 of
four strata) certifies none and is left to the base rule.

Defined results: null or empty text has no words and fails the base rule; null language is a stratum; labels
of null doc_id or quality are left out; repeated labels and rows of one id are one trial (good only if all labels
are); an empty table gives no rows; columns of the input stay as they are (internal ones begin with ``__``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, let, tasks_for, words

#: Base rule and the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: At most this share of good documents is falsely rejected per stratum, with this chance of error over all tests.
ALPHA, DELTA = 0.02, 0.05
#: Levels and risks run to STEPS; a document goes only if bad ones are likelier at its risk.
STEPS, LEAST_RISK = 20, 10
RULES = ("symbols", "capitals", "exclamations", "dup_lines", "repeats")


def repeated_words(w: Column) -> Column:
    """Words in five-word windows that occur twice or more.

    Hashes of the windows show which documents can repeat at all; only these compare the windows themselves.
    """
    last = F.size(w) - F.lit(WINDOW)
    hashes = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))))

    def covered(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + k) for k in range(WINDOW))).alias("g"), i.alias("i")))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(let(F.array_sort(windows), twice), zero, step, lambda acc: acc["n"])

    return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)), let(w, covered)).otherwise(0).cast("long")


def features(documents: DataFrame) -> DataFrame:
    """``documents`` with one more column ``__q``: a struct of the counts."""
    text = F.coalesce("text", F.lit(""))
    first = documents.withColumn("__qw", words(F.col("text"))).withColumn("__qm", F.regexp_replace(text, r"[^A-Z!#*$%&|<>]+", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, marks = F.col("__qw"), F.col("__qm")
    line_counts = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    count = lambda x: F.length(x).cast("long")
    second = first.withColumn("__ql", line_counts)
    # explode() of one element keeps filters above it, so that no rule computes the counts again
    return second.withColumn("__q", F.explode(F.array(F.struct(
        F.size(w).cast("long").alias("n_words"), count(F.array_join(w, "")).alias("word_chars"),
        count(F.regexp_replace(marks, "[A-Z!]+", "")).alias("n_symbols"), count(F.regexp_replace(marks, "[^A-Z]+", "")).alias("n_capitals"),
        count(F.regexp_replace(marks, "[^!]+", "")).alias("n_exclamations"),
        F.col("__ql")["n"].alias("n_lines"), F.col("__ql")["dup"].alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"))))).drop("__qw", "__qm", "__ql")


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def levels(q: Column) -> Column:
    """The score of each rule, in order of RULES, as a step from 0 to STEPS."""
    ratios = [(q["n_symbols"], q["n_words"]), (q["n_capitals"], q["word_chars"]), (q["n_exclamations"], q["n_words"]), (q["n_dup_lines"], q["n_lines"]), (q["n_repeat_words"], q["n_words"])]
    return F.array(*(F.least(F.lit(STEPS), F.when(b > 0, F.floor(STEPS * a / b)).otherwise(0)).cast("int") for a, b in ratios))


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 9, where its error is under 1e-13."""
    import math

    y = x.cast("double") + 9
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    shifted = F.lit(1.0)
    for i in range(1, 9):
        shifted = shifted * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(shifted)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exact but for rounding; 1 where k is above the mean, which certifies nothing.

    The largest term comes from log-factorials and the others by their ratios; terms beyond ten standard
    deviations are under 1e-20 of the largest and left out.
    """
    import math

    log_top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        j = k - i
        term = F.when(j > 0, acc["t"] * j / (n - j + 1) * odds).otherwise(0.0)
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    terms = F.least(k.cast("long"), F.ceil(10 * F.sqrt(n * p)) + 60)
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), terms), zero, step, lambda acc: acc["s"])
    return F.when(k >= n, 1.0).when(k > n * p, 1.0).otherwise(F.exp(log_top + F.log(total)))


def labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, levels, good, held: one row for each labelled doc_id that the base rule keeps.

    Rows and labels that repeat an id count once, as one trial: with the row's greatest levels, and as good only
    if all its labels are.  ``held`` rows (ten of sixteen, by a digest of the id) take no part in the grading.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") > 0).alias("good"))
    rows = scored.where(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.max("levels").alias("levels"), F.min("good").alias("good"))
    held = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "a"
    return rows.select("stratum", "levels", "good", held.alias("held"))


def grades(known: DataFrame) -> list[list[int]]:
    """Per rule and level, the share of bad among the documents at this level or above, in steps, from rows not held.

    At most rules x steps numbers; a level is graded no lower than those below it.
    """
    rows = known.where(~F.col("held")).select("good", F.posexplode("levels").alias("rule", "level")).groupBy("rule", "level")
    seen = {(r["rule"], r["level"]): (r["g"], r["b"]) for r in rows.agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).collect()}
    out = []
    for rule in range(len(RULES)):
        of = [0] * (STEPS + 1)
        for level in range(1, STEPS + 1):
            hits = [n for (r, at), n in seen.items() if r == rule and at >= level]
            good, bad = sum(g for g, _ in hits), sum(b for _, b in hits)
            of[level] = max(of[level - 1], STEPS * bad // (good + bad + 1))
        out.append(of)
    return out


def risk(levels_: Column, graded: list[list[int]]) -> Column:
    """The worst grade that a document's levels have, from 0 to STEPS."""
    table = F.array(*(F.array(*map(F.lit, g)) for g in graded))
    return F.array_max(F.transform(levels_, lambda x, r: F.get(F.get(table, r), x)))


def cutoffs(known: DataFrame, graded: list[list[int]], alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoff: the least certified risk at which documents are rejected, of strata that have one.

    On held-out labels alone, each stratum tests its cutoffs in the fixed order from the one that rejects least;
    the tails rise along it, so the certified ones are those of tails up to ``delta`` over the number of strata.
    """
    held = known.where("held").select("stratum", "good", risk(F.col("levels"), graded).alias("risk"))
    seen = held.where("good").groupBy("stratum", "risk").agg(F.count("*").alias("n"))
    total = seen.groupBy("stratum").agg(F.sum("n").alias("good"))
    strata = total.count()
    grid = total.withColumn("cutoff", F.explode(F.array(*map(F.lit, range(LEAST_RISK, STEPS + 1)))))
    hits = grid.join(seen.select(F.col("stratum").alias("s"), "risk", "n"), F.expr("stratum = s and risk >= cutoff"), "left")
    hits = hits.groupBy("stratum", "good", "cutoff").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k"))
    passed = hits.where(binomial_tail(F.col("k"), F.col("good"), alpha) <= delta / max(strata, 1))
    return passed.groupBy("stratum").agg(F.min("cutoff").alias("cutoff"))


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, stratum, counts, base_failed and levels, checkpointed: some numbers for each document."""
    q = F.col("__q")
    f = features(gathered(documents).select("doc_id", "lang", "text")).select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "__q")
    return cut(f.select("doc_id", "stratum", "__q", base_failed(q).alias("base_failed"), levels(q).alias("levels")))


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each document."""
    rows = scored(documents)
    known = cut(labelled(rows, labels).coalesce(tasks_for(documents)))
    graded = grades(known)
    chosen = cut(cutoffs(known, graded), 1).withColumnRenamed("stratum", "__s")
    kept = ~F.col("base_failed") & F.coalesce(risk(F.col("levels"), graded) < F.col("cutoff"), F.lit(True))
    return rows.join(chosen, F.col("stratum") == F.col("__s"), "left").select("doc_id", "__q.*", "base_failed", kept.alias("kept"))


def filter_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns.  Texts don't move: features are computed again beside them."""
    known = cut(labelled(scored(documents), labels).coalesce(tasks_for(documents)))
    graded = grades(known)
    chosen = cut(cutoffs(known, graded), 1).select(F.col("stratum").alias("__s"), F.col("cutoff").alias("__cutoff"))
    q = F.col("__q")
    rows = features(gathered(documents)).withColumn("__stratum", F.coalesce("lang", F.lit(""))).where(~base_failed(q))
    rows = rows.join(chosen, F.col("__stratum") == F.col("__s"), "left")
    return rows.where(F.coalesce(risk(levels(q), graded) < F.col("__cutoff"), F.lit(True))).select(*(F.col(f"`{c}`") for c in documents.columns))
