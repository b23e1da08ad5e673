import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import apply, lcs, rouge_l, rouge_n, words
from pyspark.sql import functions as F

from gistmill.functions import rouge, softmatch, wordtable
from gistmill.functions.stem import porter_stem, stem_words
from gistmill.operators import lookup
from gistmill.operators import metrics as m
from gistmill.session import materialize


def random_pairs(seed, n, most=30):
    rng = random.Random(seed)
    vocabulary = ["the", "cat", "sat", "on", "a", "Mat", "dogs", "x1", "é", "--"]

    def text():
        return " ".join(rng.choices(vocabulary, k=rng.randint(0, most)))

    return [(i, text(), text()) for i in range(n)]


def test_rouge_against_plain_python(spark):
    pairs = random_pairs(1, 300) + [(1000, "", ""), (1001, "same", "same"), (1002, "one", ""), (1003, "?!", "ok")]
    df = spark.createDataFrame(pairs, "id int, prediction string, reference string")
    for row in m.score_pairs(df, stem=False).collect():
        p, r = row.prediction, row.reference
        assert row.rouge1 == rouge_n(p, r, 1)
        assert row.rouge2 == rouge_n(p, r, 2)
        assert row.rougeL == rouge_l(p, r)


def test_identical_texts_score_one_and_no_row_is_lost(spark):
    df = spark.createDataFrame(
        [(1, "a b c", "a b c"), (2, "", "a"), (3, None, "a b"), (4, "...", "...")], "id int, prediction string, reference string"
    )
    rows = {r.id: r for r in m.score_pairs(df).collect()}
    assert len(rows) == 4 and rows[1].rouge1 == rows[1].rouge2 == rows[1].rougeL == 1.0
    assert rows[2].rouge1 == rows[3].rouge1 == rows[4].rougeL == 0.0


def test_precision_and_recall(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat on the mat")], "prediction string, reference string")
    (row,) = m.score_pairs(df, stem=False, details=True).collect()
    assert (row.rouge1_precision, row.rouge1_recall) == (1.0, 0.5)
    assert (row.rouge2_precision, row.rouge2_recall) == (1.0, 0.4)
    assert (row.rougeL_precision, row.rougeL_recall) == (1.0, 0.5)


def test_lcs_of_long_texts(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcdef") for _ in range(300)], [rng.choice("abcdef") for _ in range(250)]) for _ in range(3)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in pairs], "a string, b string")
    assert [r[0] for r in df.select(rouge.lcs_length("a", "b")).collect()] == [lcs(a, b) for a, b in pairs]


def test_lcs_of_many_pairs_at_once():
    """Around the 64 words that fit one mask, with repeated words, empty and null texts."""
    rng = random.Random(5)
    pairs = [([], []), (["a"], []), ([], ["b"]), (["a"] * 64, ["a"] * 200), (["a", "b"] * 32, ["b", "a"] * 40), (["a"] * 65, ["a"] * 66)]
    for most in (3, 63, 64, 65, 130):
        for kinds in (2, 9, 300):
            pairs += [tuple([f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, most))] for _ in "lr") for _ in range(12)]
    rng.shuffle(pairs)
    left, right = ([" ".join(p[k]) or rng.choice([None, ""]) for p in pairs] for k in (0, 1))
    found = rouge.lcs_lengths(pa.array(left, pa.string()), pa.array(right, pa.string()))
    assert found.tolist() == [lcs(*p) for p in pairs]
    assert rouge.lcs_lengths(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []


def test_texts_of_a_batch_are_worked_on_in_bounded_pieces(spark, monkeypatch):
    """However many pairs a batch has, stems and LCS hold a piece; stemmed scores take one Python step, not three."""
    pairs = random_pairs(7, 90, 40) + [(900, None, "a b"), (901, "", "")]
    left, right = (pa.array([p[k] and " ".join(words(p[k])) for p in pairs], pa.string()) for k in (1, 2))
    sizes, whole = [], rouge.lcs_lengths(left, right).tolist()
    true_lengths = rouge.lcs_lengths
    monkeypatch.setattr(rouge, "lcs_lengths", lambda a, b: sizes.append(len(a)) or true_lengths(a, b))
    monkeypatch.setattr(wordtable, "PIECE_ROWS", 10, raising=False)
    (found,) = rouge.lcs_length.func(iter([(left, right)]))
    (stems,) = rouge.stemmed_pair.func(iter([(left, right)]))
    assert found.to_pylist() == whole and max(sizes) <= 10
    assert stems.field("pred").to_pylist() == [" ".join(porter_stem(w) if len(w) >= 4 else w for w in (x or "").split()) for x in left.to_pylist()]
    df = spark.createDataFrame(pairs, "id int, prediction string, reference string")
    plan = m.score_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_ngrams(spark):
    assert apply(spark, lambda c: rouge.ngrams(c, 2), [["a", "b", "c"], ["a"], []], "array<string>") == [["a b", "b c"], [], []]
    assert apply(spark, lambda c: rouge.ngrams(c, 3), [["a", "b", "c", "d"]], "array<string>") == [["a b c", "b c d"]]


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("flies", "fli"), ("dies", "die"), ("died", "die"), ("spied", "spi"),
        ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
        ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"),
        ("happy", "happi"), ("enjoy", "enjoy"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"),
        ("radically", "radic"), ("hopefully", "hope"), ("vietnamization", "vietnam"), ("callousness", "callous"),
        ("sensibility", "sensibl"), ("triplicate", "triplic"), ("electrical", "electr"), ("goodness", "good"),
        ("revival", "reviv"), ("replacement", "replac"), ("adoption", "adopt"), ("activate", "activ"), ("rate", "rate"),
        ("cease", "ceas"), ("controlling", "control"), ("roll", "roll"), ("geology", "geolog"), ("theology", "theolog"),
        ("skies", "sky"), ("dying", "die"), ("news", "news"), ("innings", "inning"), ("succeed", "succeed"), ("owed", "owe"),
    ],
)
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_short_words_are_not_stemmed(spark):
    assert apply(spark, stem_words, ["was running cats", ""]) == ["was run cat", ""]


def test_stemming_changes_scores(spark):
    df = spark.createDataFrame([("models running", "model runs")], "prediction string, reference string")
    assert m.score_pairs(df, stem=False).first().rouge1 == 0.0
    assert m.score_pairs(df, stem=True).first().rouge1 == 1.0


def test_scoring_needs_no_shuffle(spark):
    df = spark.createDataFrame([("a", "b")], "prediction string, reference string")
    assert "Exchange" not in m.score_pairs(df)._jdf.queryExecution().executedPlan().toString()


def test_alignment(spark):
    preds = spark.createDataFrame([("test", "a"), ("test", "b"), ("test", "b")], "split string, id string")
    refs = spark.createDataFrame([("test", "a"), ("test", "b"), ("test", "c")], "split string, id string")
    m.check_aligned(refs, refs)
    assert {r.id for r in m.mismatched_keys(preds, refs).collect()} == {"b", "c"}
    with pytest.raises(ValueError, match="length mismatch"):
        m.check_aligned(preds.limit(2), refs.limit(1))


def brute_embedding_f1(p, r, vectors):
    p, r = [vectors[t] for t in words(p)], [vectors[t] for t in words(r)]
    if not p or not r:
        return 0.0
    cos = [[float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) for b in r] for a in p]
    precision = sum(map(max, cos)) / len(p)
    recall = sum(max(row[j] for row in cos) for j in range(len(r))) / len(r)
    return 2 * precision * recall / (precision + recall)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_embedding_f1_by_broadcast_and_by_salted_join(spark, broadcast_bytes):
    rng = np.random.default_rng(3)
    pairs = random_pairs(4, 40, most=12)
    vectors = {t: rng.random(8) for t in ("the", "cat", "sat", "on", "a", "mat", "dogs", "x1")}
    table = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in vectors.items()], "token string, vector array<double>")
    df = spark.createDataFrame(pairs, "id int, prediction string, reference string")
    scored = m.embedding_f1(df, table, ["id"], broadcast_bytes=broadcast_bytes)
    got = {r.id: r.bertscore_f1 for r in scored.collect()}
    assert len(got) == 40
    for i, p, r in pairs:
        assert got[i] == pytest.approx(brute_embedding_f1(p, r, vectors))


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_words_without_vector_and_repeated_rows(spark, broadcast_bytes):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("n", None)], "token string, vector array<double>")
    rows = [(1, "a zz", "a"), (1, "a zz", "a"), (2, "zz", "zz"), (3, None, "a"), (4, "n a", "n a"), (1, "a", "a")]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    found = sorted((r.id, round(r.bertscore_f1, 6)) for r in m.embedding_f1(df, table, ["id"], broadcast_bytes=broadcast_bytes).collect())
    assert found == [(1, 0.666667), (1, 0.666667), (1, 1.0), (2, 0.0), (3, 0.0), (4, 0.5)]
    assert m.embedding_f1(df.limit(0), table, ["id"], broadcast_bytes=broadcast_bytes).collect() == []
    assert {r.bertscore_f1 for r in m.embedding_f1(df, table.limit(0), ["id"], broadcast_bytes=broadcast_bytes).collect()} == {0.0}


def test_pairs_are_scored_in_their_rows_or_in_blocks(spark, monkeypatch):
    """With a small table nothing is shuffled; with a large one a block asks for a word once, and no pair carries a vector."""
    table = materialize(spark.createDataFrame([(w, [1.0, float(k)]) for k, w in enumerate("abc")], "token string, vector array<double>"))
    df = materialize(spark.createDataFrame([(i, "a b a", "b c") for i in range(50)], "id int, prediction string, reference string").coalesce(1))
    plan = m.embedding_f1(df, table, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "Generate", "Aggregate", "Join"))
    monkeypatch.setattr(softmatch, "BLOCK_ROWS", 25)
    asked = []
    true_lookup = lookup.frequent_lookup
    monkeypatch.setattr(lookup, "frequent_lookup", lambda rows, *more: asked.append(rows) or true_lookup(rows, *more))
    assert m.embedding_f1(df, table, ["id"], broadcast_bytes=-1).count() == 50
    assert asked[0].count() == 6 and set(asked[0].columns) == {"asker", "token"}


def test_bootstrap(spark):
    rng = random.Random(6)
    scores = [rng.random() for _ in range(400)]
    rows = [("r", "val", str(i), s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "name string, split string, id string, rouge1 double")
    one = m.bootstrap_interval(df, metrics=["rouge1"], resamples=400).first()
    other = m.bootstrap_interval(df.repartition(9), metrics=["rouge1"], resamples=400).first()
    mean = sum(scores) / 400
    error = np.std(scores) / math.sqrt(400)
    assert one.rouge1_low < mean < one.rouge1_high and abs(one.rouge1_mid - mean) < error / 2
    assert one.rouge1_high - one.rouge1_low == pytest.approx(2 * 1.96 * error, rel=0.2)
    assert one.rouge1_low == pytest.approx(other.rouge1_low, abs=1e-12)


def test_poisson_cutoffs_follow_the_distribution():
    cutoffs = [int(c, 16) / 16**8 for c in m.poisson_cutoffs()]
    shares = [b - a for a, b in zip([0.0, *cutoffs], [*cutoffs, 1.0])]
    assert sum(k * s for k, s in enumerate(shares)) == pytest.approx(1, abs=1e-6)
    assert shares[0] == pytest.approx(math.exp(-1), abs=1e-9)


def test_corpus_scores(spark):
    df = spark.createDataFrame(
        [("r", "val", 1.0), ("r", "val", 0.5), ("r", "test", 0.0)], "name string, split string, rouge1 double"
    ).withColumns({"rouge2": F.col("rouge1"), "rougeL": F.col("rouge1")})
    assert {(r.split, r.rouge1, r.n) for r in m.corpus_scores(df).collect()} == {("val", 0.75, 2), ("test", 0.0, 1)}
