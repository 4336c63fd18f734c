"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, size long, score double, node string, pieces string, block int"


def documents(spark, extra=()):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "en", "a"), (2, base + " phi", "en", "a"), (2, base + " phi", "en", "a"), (3, base.upper(), None, None), (4, "", "fr", "b"),
        (5, None, "fr", None), (None, "some words here", "en", "a"), (None, None, None, None), (6, "x", "de", "ö"), (7, " \n\t ", "de", "z"),
        (8, "word " * 30_000, "en", "b"), (9, "y" * 40_000, "en", "b"), (10, "İ dot " * 12 + "😀 ½ 日本語", "en", "c"), *extra,
    ]
    return spark.createDataFrame([(*r, 0, 1, 2, 0.5, "n", "p", 3) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
