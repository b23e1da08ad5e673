"""Small helpers, and plain-Python versions of the metrics to compare with."""

import re
from collections import Counter

from pyspark.sql import functions as F


def apply(spark, function, values, kind="string"):
    """Results of a one-argument Column function, in input order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", function(F.col("x"))).collect())]


def words(text):
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def grams(tokens, n):
    return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def f_measure(hits, predicted, expected):
    return 2.0 * hits / (predicted + expected) if hits else 0.0


def rouge_n(prediction, reference, n):
    p, r = grams(words(prediction), n), grams(words(reference), n)
    return f_measure(sum((Counter(p) & Counter(r)).values()), len(p), len(r))


def lcs(p, r):
    table = [[0] * (len(r) + 1) for _ in range(len(p) + 1)]
    for i, a in enumerate(p):
        for j, b in enumerate(r):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def rouge_l(prediction, reference):
    p, r = words(prediction), words(reference)
    return f_measure(lcs(p, r), len(p), len(r))
