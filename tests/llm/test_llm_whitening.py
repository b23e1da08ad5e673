"""Whitening against eigenvectors of the covariance, computed with exact integers and numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm.whitening import whiten

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("size", T.StringType()),
    T.StructField("component", T.StringType()), T.StructField("N", T.StringType()),
])


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, "a", None, "c") for i, v in rows], SCHEMA).repartition(partitions)


def brute(rows, count=8):
    """{(id, component): (n, deviation, |whitened| or None, explained)} of vectors of one length."""
    xs = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, d = len(xs), len(xs[0][1])
    sums = [sum(x[k] for _, x in xs) for k in range(d)]
    centred = np.array([[(n * x[k] - sums[k]) / n for k in range(d)] for _, x in xs])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for (i, x), row in zip(xs, centred):
        deviation = sum((n * x[k] - sums[k]) ** 2 for k in range(d))
        for c in range(min(count, d)):
            e = values[-1 - c]
            white = abs(float(row @ vectors[:, -1 - c])) / math.sqrt(e) if e > 1e-9 * max(values[-1], 1e-300) else None
            out.append((i, c + 1, n, deviation, white, max(e, 0) / values.sum() if values.sum() else 0.0))
    return out


def same(found, expected):
    assert len(found) == len(expected)
    key = lambda r: (str(r[0]), r[1], r[2], r[3], -1 if r[4] is None else round(abs(r[4]), 6))
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key)):
        assert a[:4] == b[:4]
        assert (a[4] is None) == (b[4] is None) and (a[4] is None or abs(abs(a[4]) - b[4]) < 1e-7)
        assert abs(a[5] - b[5]) < 1e-9


def plain(df):
    return [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in df.select("vec_id", "component", "n", "deviation", "whitened", "explained").collect()]


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_eigenvectors(spark, partitions):
    rng = np.random.default_rng(3)
    mixing = rng.normal(0, 0.2, (12, 12)) * np.geomspace(1, 0.02, 12)
    rows = [(i, (rng.normal(size=12) @ mixing.T + 2).tolist()) for i in range(700)]
    rows += [(5, rows[5][1]), (None, rows[6][1])]
    unusable = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [math.inf] * 12), (903, [math.nan] * 12), (904, [])]
    out = whiten(frame(spark, rows + unusable, partitions))
    same(plain(out), brute(rows))
    errors = {r[0] for r in out.select("identity_error").distinct().collect()}
    assert len(errors) == 1 and max(errors) < 1e-9
    # one sign for all rows: the whitened values have the covariance of independent units
    white = out.groupBy("component").agg(F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.v - 1) < 1e-9 for r in white)


def test_no_variance_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    dependent = [(i, [a, b, a + b, 0.5]) for i, (a, b) in enumerate((np.floor(rng.normal(0, 200, (60, 2))) / 1024).tolist())]
    same(plain(whiten(frame(spark, dependent))), brute(dependent))
    flat = [(i, [0.25, 0.5, -0.5]) for i in range(4)]
    found = whiten(frame(spark, flat)).collect()
    assert len(found) == 12 and {(r.whitened, r.explained, r.identity_error, r.deviation) for r in found} == {(None, 0.0, None, 0)}
    both = plain(whiten(frame(spark, dependent + [(100 + i, v) for i, v in flat])))
    same([r for r in both if r[0] < 100], brute(dependent))
    same([r for r in both if r[0] >= 100], brute([(100 + i, v) for i, v in flat]))
    assert [r.whitened for r in whiten(frame(spark, flat[:1])).collect()] == [None] * 3
    assert whiten(frame(spark, [])).collect() == [] and whiten(frame(spark, [(1, None)])).collect() == []


def test_badly_conditioned_and_large(spark):
    """Variances 10^12 apart on a large offset, and squares beyond 64 bits."""
    rng = np.random.default_rng(5)
    scales = np.array([1e6, 3e3, 30, 1.0])
    rows = [(i, (rng.normal(size=4) * scales).astype(np.float32).tolist()) for i in range(500)]
    found = plain(whiten(frame(spark, rows)))
    assert {(r[0], r[1], r[2], r[3]) for r in found} == {r[:4] for r in brute(rows)}
    # the covariance squares the condition: only its larger components are a reference
    for a, b in zip(sorted(r for r in found if r[1] < 3), sorted(r for r in brute(rows) if r[1] < 3)):
        assert abs(abs(a[4]) - b[4]) < 1e-6
    white = np.array([[r[4] for r in sorted(found) if r[1] == c] for c in range(1, 5)])
    assert np.abs(white @ white.T / 500 - np.eye(4)).max() < 1e-9
    with pytest.raises(Exception, match="beyond what is exact"):
        whiten(frame(spark, [(1, [1e30, 0.0])])).collect()
