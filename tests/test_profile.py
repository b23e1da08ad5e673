import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.operators import profile as prof
from gistmill.session import materialize

ROWS = [
    ("train" if i % 3 else "val", f"i{i}", " ".join(["w"] * n), " ".join(["s"] * k))
    for i, (n, k) in enumerate(random.Random(8).choices([(a, b) for a in range(0, 90, 3) for b in range(1, 9)], k=300))
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, "split string, id string, abstract string, summary string")


def values(split, field):
    return np.array([len(r[field].split()) for r in ROWS if r[0] == split])


def test_profile_matches_numpy(records):
    rows = prof.length_profile(prof.length_counts(prof.text_lengths(records))).collect()
    assert len(rows) == 4
    for r in rows:
        x = values(r.split, 2 if r.measure == "abstract_tokens" else 3)
        assert (r.n, r.max) == (len(x), x.max()) and r.mean == pytest.approx(x.mean())
        assert [r.p5, r.median, r.p95] == pytest.approx([np.percentile(x, q) for q in (5, 50, 95)])


def test_compression_matches_numpy(records):
    for r in prof.compression_ratio(prof.ratio_counts(prof.text_lengths(records))).collect():
        ratio = values(r.split, 3) / np.maximum(values(r.split, 2), 1)
        assert r.mean == pytest.approx(ratio.mean()) and r.median == pytest.approx(np.median(ratio))


def test_percentiles_of_few_and_hot_values(spark):
    samples = {"one": [7.5], "two": [1.0, 2.0], "hot": [3.0] * 999 + [1000.0], "neg": [-5.0, -1.5, 0.0, 2.25]}
    counts = spark.createDataFrame([(k, v) for k, x in samples.items() for v in x], "g string, value double")
    counts = counts.groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"))
    points = [0.0, 0.05, 0.5, 0.95, 1.0]
    for scale in (0.001, 1.0, 512.0):
        got = {(r.g, r.probability): r.value for r in prof.weighted_percentiles(counts, ["g"], points, scale).collect()}
        assert len(got) == 20
        for (g, q), value in got.items():
            assert value == pytest.approx(np.percentile(samples[g], 100 * q))


@pytest.mark.parametrize("bins", [30, 40])
def test_histogram_matches_numpy(records, bins):
    counts = prof.length_counts(prof.text_lengths(records)).filter("measure = 'abstract_tokens'")
    rows = prof.histogram(counts, bins).orderBy("split", "bin").collect()
    for split in ("train", "val"):
        x = values(split, 2)
        got = [r for r in rows if r.split == split]
        edges = np.linspace(x.min(), x.max(), bins + 1)
        assert [r.low for r in got] == pytest.approx(list(edges[:-1])) and got[-1].high == pytest.approx(x.max())
        assert sum(r.n for r in got) == len(x)
        exact = np.minimum((x - x.min()) * bins // (x.max() - x.min()), bins - 1)
        assert [r.n for r in got] == list(np.bincount(exact, minlength=bins))


def test_histogram_of_one_value(spark):
    counts = spark.createDataFrame([("train", 5, 12)], "split string, value long, n long")
    rows = prof.histogram(counts, 40).orderBy("bin").collect()
    expected, edges = np.histogram([5] * 12, bins=40)
    assert [r.n for r in rows] == list(expected)
    assert [r.low for r in rows] == pytest.approx(list(edges[:-1]))


def test_report(records):
    report = {r.split: r for r in prof.profile_report(records).collect()}
    train = values("train", 2)
    assert report["train"].size == len(train) and report["train"].abstract_tokens.p95 == pytest.approx(np.percentile(train, 95))
    assert set(report) == {"train", "val"} and report["val"].summary_tokens.n == len(values("val", 3))
    assert report["val"].compression_ratio.mean > 0


def test_other_length_function(records):
    lengths = prof.text_lengths(records, F.length)
    assert lengths.agg(F.max("summary_tokens")).first()[0] == max(len(r[3]) for r in ROWS)


def test_examples(spark):
    df = spark.createDataFrame([(f"i{i}", "x" * 400, "s") for i in range(6)], "id string, abstract string, summary string")
    rows = prof.example_rows(df).collect()
    assert len(rows) == 4 and all(r.abstract == "x" * 300 + "…" for r in rows)


def test_missing_texts_have_no_length(spark):
    rows = [("t", "a b c d", "x y"), ("t", None, "z"), ("t", "a b c d", None)]
    records = spark.createDataFrame(rows, "split string, abstract string, summary string")
    lengths = prof.text_lengths(records)
    got = {r.measure: (r.n, r["mean"], r["median"]) for r in prof.length_profile(prof.length_counts(lengths)).collect()}
    assert got == {"abstract_tokens": (2, 4.0, 4.0), "summary_tokens": (2, 1.5, 1.5)}
    (ratio,) = prof.compression_ratio(prof.ratio_counts(lengths)).collect()
    assert (ratio["mean"], ratio["median"]) == (0.5, 0.5)


def test_report_shows_examples_of_every_split(spark):
    rows = [("a", f"i{k}", f"text {k} " + "long " * 100, f"s{k}") for k in range(9)] + [("b", "j", "only", "one")]
    records = spark.createDataFrame(rows, "split string, id string, abstract string, summary string")
    got = {r.split: r for r in prof.profile_report(records).collect()}
    assert got["a"]["size"] == 9 and len(got["a"].examples) == 4 and len(got["a"].examples[0].abstract) == 301
    assert [tuple(x) for x in got["b"].examples] == [("only", "one")]


def test_sketches_of_batches_merge(spark):
    """Merged states answer as one pass does, within the stated error of exact ranks; missing texts have no length."""
    rng = random.Random(4)
    rows = [("s" if k % 3 else "t", k % 7, rng.randint(0, 10_000) if k % 50 else None, rng.randint(1, 90)) for k in range(9000)]
    lengths = spark.createDataFrame(rows, "split string, batch int, abstract_tokens int, summary_tokens int")
    states = materialize(prof.length_sketches(lengths, ["split", "batch"]))
    assert states.count() == 2 * 7 * 3
    merged = prof.merge_sketches(states)
    probabilities = [0.0, 0.05, 0.5, 0.95, 1.0]
    found = {
        kind: {(r.split, r.measure, r.probability): (r.n, r.value) for r in prof.sketch_quantiles(x, probabilities=probabilities).collect()}
        for kind, x in (("merged", merged), ("once", prof.length_sketches(lengths)))
    }
    for split in "st":
        own = [r for r in rows if r[0] == split]
        exact = {
            "abstract_tokens": [r[2] for r in own if r[2] is not None], "summary_tokens": [r[3] for r in own],
            "compression_ratio": [r[3] / max(r[2], 1) for r in own if r[2] is not None],
        }
        for measure, values in exact.items():
            for p in probabilities:
                for kind in found:
                    n, value = found[kind][split, measure, p]
                    assert n == len(values)
                    below, upto = sum(x < value for x in values) / n, sum(x <= value for x in values) / n
                    assert below - 0.015 <= p <= upto + 0.015
