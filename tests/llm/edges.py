"""Rows that every operator must survive."""

from __future__ import annotations

LONG = "word " * 60_000

ROWS = [
    (1, "alpha beta gamma delta", "en", "a", "x"),
    (2, None, None, None, None),
    (3, "", "en", "a", None),
    (None, "alpha beta gamma delta", "en", "b", "y"),
    (None, None, None, None, None),
    (4, LONG, "en", "b", "z"),
    (5, "alpha beta gamma delta", "de", "a", "x"),
    (5, "alpha beta gamma delta", "de", "a", "x"),
    (6, " \t\n", "de", None, "x"),
    (7, "12 34 !!", "fr", "c", "x"),
    (8, "ß İ \U0001f600 é", "fr", "c", "x"),
]
#: names that operators use for columns of their own
CLASHES = ["row", "shard", "slot", "bucket", "pos", "mix", "copy", "key", "digest", "fp", "rank", "Score", "n", "u"]


def documents(spark, rows=None):
    df = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, lang string, source string, `a.b` string")
    return df.selectExpr("*", *[f"`a.b` AS `{c}`" for c in CLASHES])


def empty(spark):
    return documents(spark, [])
