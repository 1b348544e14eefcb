"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, n string, k string"
LONG = "word one two. " * 3000 + "x" * 5000


def odd_docs(spark, extra=()):
    rows = [(1, "Hello there, dear friends of mine.\nSecond line here.", "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"), (5, "12 34 ---", "de"), (6, "é", "fr"), (6, "é", "fr"), (7, " \t\n", "en"), (None, "no id at all here today", "en"), *extra]
    return spark.createDataFrame([(i, t, g, "s", 1, 0.5, "x", "y", "z") for i, t, g in rows], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
