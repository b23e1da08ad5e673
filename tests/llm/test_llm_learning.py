"""Quality and toxicity scores: held-out accuracy and awkward input."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, fold, frame, kept_columns, vocabulary

from gistmill.llm import toxicity
from gistmill.llm.learning import remainder
from gistmill.llm.quality import quality_scores
from gistmill.llm.toxicity import toxicity_scores


def labelled(seed, bad):
    rng = random.Random(seed)
    words = vocabulary(rng, 300)
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randint(5, 80))
        label = int(rng.random() < 0.3)
        rows.append((i, " ".join(bad(rng, text) if label else text)))
        labels.append((i, label))
    return rows, labels


def junk(rng, text):
    return [w + rng.choice(["***", "$$$", "&&&"]) for w in text]


def insult(rng, text):
    stem = rng.choice(["vilifan", "scorne", "dwimbal"])
    text[rng.randrange(len(text))] = stem + "".join(rng.choice("aeioustr") for _ in range(rng.randint(1, 4)))
    return text


@pytest.mark.parametrize("score, bad, column", [(quality_scores, junk, "quality"), (toxicity_scores, insult, "toxic")])
def test_held_out(spark, score, bad, column):
    rows, known = labelled(3, bad)
    docs = frame(spark, rows + awkward())
    labels = spark.createDataFrame([*known, (None, 1), (5000, None), (5001, 7)], f"doc_id long, {column} int")
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    found = score(docs, labels, remainder("doc_id", 5) != 0, label_column=column)
    got = {r.doc_id: r.score for r in found.collect()}
    right = [(got[i] >= 0.3) == (y == 1) for i, y in known if i in held]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert all(0 <= x <= 1 for x in got.values())
    assert got[1000] == got[1001]
    kept_columns(docs, found, {"score"})


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_without_labels(spark, score):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, y int")
    assert {round(r.score, 6) for r in score(docs, none, remainder("doc_id", 5) != 0, "y").collect()} == {0.5}
    if score is toxicity_scores:
        for labels in (none, spark.createDataFrame([(1003, 1)], "doc_id long, y int")):
            assert max(r.score for r in score(docs, labels, remainder("doc_id", 1) == 0, "y", untrained=0.0).collect()) < 1e-9
    one = spark.createDataFrame([(1003, 1)], "doc_id long, y int")
    assert len({round(r.score, 6) for r in score(docs, one, remainder("doc_id", 1) == 0, "y").collect()}) == 1
    assert score(frame(spark, []), none, remainder("doc_id", 5) != 0, "y").collect() == []


def test_toxicity_spread_over_many_mild_words():
    """60 against 25 mild words of 120: no single word tells."""
    rng = random.Random(1)
    known = vocabulary(rng, 400)
    mild, rest = known[:60], known[60:]
    rows = []
    for k in range(900):
        many = 60 if k % 2 else 25
        text = rng.choices(mild, k=many) + rng.choices(rest, k=120 - many)
        rng.shuffle(text)
        rows.append((" ".join(text), k % 2))
    model = np.frombuffer(toxicity.fit(*map(list, zip(*rows[:600]))), np.float32)
    found = toxicity.scores(pa.array([t for t, _ in rows[600:]]), model)
    good, bad = (found[[y == k for _, y in rows[600:]]] for k in (0, 1))
    assert (bad[:, None] > good[None, :]).mean() > 0.99


def test_bag_against_plain_python():
    """Text odds from lists of subwords, and gradients by differences."""
    texts = ["Bad bad, ba\u00e9d.", "", "good 1x", "x" * 9 + " good bad", None, "!!"]
    rng = np.random.default_rng(2)
    table = rng.normal(0, 1, 1 << toxicity.BITS)
    bags = toxicity._Bags(pa.array(texts))

    def bucket(piece, n):
        h = sum(int(toxicity._TABLES[k][b]) for k, b in enumerate(piece[:n])) % 2**64
        return int(toxicity.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - toxicity.BITS))

    def odds(word):
        marked = b"<" + word + b">"
        grams = [bucket(marked[at:at + n], n) for n in range(3, 7) for at in range(len(marked) - n + 1)]
        whole = int(toxicity.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hashes()[0] >> np.uint64(64 - toxicity.BITS))
        return np.mean([table[b] for b in [*grams, whole]])

    expected = []
    for text in texts:
        found = [odds(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", fold(text or "").encode())]
        weights = np.exp(found)
        expected.append(float(weights @ found / weights.sum()) if found else math.nan)
    words = bags.odds(table)
    pooled, share = toxicity._pooled(bags.doc, bags.times, words[bags.word].astype(float), len(texts))
    assert pooled == pytest.approx(expected, rel=1e-5, nan_ok=True)
    index, cut = bags.subwords()
    vectors, direction, wrong = rng.normal(0, 1, (1 << toxicity.BITS, 2)), np.array([0.7, -0.4]), rng.normal(0, 1, len(texts))

    def total(v, d):
        o = np.add.reduceat((v @ d)[index], cut[:-1]) / np.diff(cut)
        found, part = toxicity._pooled(bags.doc, bags.times, o[bags.word], len(texts))
        return float(np.nansum(wrong * found)), o, found, part

    _, o, found, part = total(vectors, direction)
    slope, toward = toxicity._gradients(bags, index, cut, vectors, wrong, o, found, part)
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert (total(vectors, direction + step)[0] - total(vectors, direction - step)[0]) / 2e-6 == pytest.approx(toward[k], rel=1e-4)
    for at in index[::7]:
        step = np.zeros_like(vectors)
        step[at, 0] = 1e-6
        assert (total(vectors + step, direction)[0] - total(vectors - step, direction)[0]) / 2e-6 == pytest.approx(slope[at] * direction[0], rel=1e-4, abs=1e-9)


def test_score_of_a_text_does_not_depend_on_its_batch(spark):
    rows, known = labelled(4, junk)
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    scores = [
        {r.doc_id: r.score for r in quality_scores(frame(spark, rows, n), labels, remainder("doc_id", 5) != 0).collect()} for n in (1, 7)
    ]
    assert scores[0] == pytest.approx(scores[1])
