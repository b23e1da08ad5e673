"""Toxicity scores: averaged subword embeddings and a linear softmax, trained jointly.

A word's bag holds hashes of its byte n-grams of 3 to 6 with marks at its ends, and of
itself; its vector is the mean of their embeddings. A text's vector is the weighted mean over all its
words, each as often as it occurs, with learnt weights: the exponential of the word's odds under the softmax. So one
strong word isn't lost in a long text, many mild ones add up, and no word is left out. Misspellings and new
endings share n-grams with known words.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from gistmill.llm import learning
from gistmill.llm.quality import scored
from gistmill.llm.words import LETTERS, LOWER, Words, mix, text_bytes

BITS, WIDTH, SHORT, LONG = 17, 8, 3, 6
_TABLES = np.random.Generator(np.random.PCG64(70)).integers(0, 1 << 63, (LONG, 256), dtype=np.uint64)


class _Bags:
    """The distinct words of some texts with their subwords, and which texts have them how often."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        words = Words(LOWER[data], offsets, LETTERS)
        _, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.texts = len(words.counts)
        pairs, self.times = np.unique(words.doc().astype(np.int64) * max(len(first), 1) + of.ravel(), return_counts=True)
        self.doc, self.word = np.divmod(pairs, max(len(first), 1))
        start, size = words.start[first], (words.end - words.start)[first]
        # each word between marks
        room = size + 2
        self.begin = np.cumsum(room) - room
        place = np.arange(int(room.sum())) - np.repeat(self.begin, room)
        marked = np.full(len(place), 0x3C, np.uint8)
        inner = (place > 0) & (place <= np.repeat(size, room))
        marked[inner] = words.data[(place + np.repeat(start, room) - 1)[inner]]
        marked[place > np.repeat(size, room)] = 0x3E
        self.marked, self.room = marked, room
        self.left = np.repeat(room, room) - place
        self.whole = (words.hashes()[first] >> np.uint64(64 - BITS)).astype(np.int32)

    def ngrams(self):
        """(bucket of the n-gram at each place, whether the word has one there) for each length."""
        h = np.zeros(len(self.marked), np.uint64)
        for n in range(LONG):
            h[:max(len(h) - n, 0)] += _TABLES[n][self.marked[n:]]
            if n + 1 >= SHORT:
                yield (mix(h) >> np.uint64(64 - BITS)).astype(np.int32), self.left > n

    def odds(self, subword_odds: np.ndarray) -> np.ndarray:
        """For each distinct word the mean of its subwords' odds."""
        total, count = np.zeros(len(self.marked), np.float32), np.zeros(len(self.marked), np.float32)
        for bucket, there in self.ngrams():
            total += np.where(there, subword_odds[bucket], 0)
            count += there
        if not len(self.begin):
            return np.zeros(0, np.float32)
        return (np.add.reduceat(total, self.begin) + subword_odds[self.whole]) / (np.add.reduceat(count, self.begin) + 1)

    def subwords(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words' subwords, word by word, and where each word's begin and the last's end."""
        lengths = np.clip(self.left - SHORT + 1, 0, LONG - SHORT + 1)
        per_word = (np.add.reduceat(lengths, self.begin) if len(self.begin) else np.zeros(0, np.int64)) + 1
        cut = np.concatenate([[0], np.cumsum(per_word)])
        bucket = np.empty(cut[-1], np.int32)
        bucket[cut[1:] - 1] = self.whole
        # n-grams of a place one after another; each word before has one subword more, itself
        at = np.cumsum(lengths) - lengths + np.repeat(np.arange(len(self.room)), self.room)
        for k, (found, there) in enumerate(self.ngrams()):
            bucket[at[there] + k] = found[there]
        return bucket, cut


def _pooled(doc: np.ndarray, times: np.ndarray, odds: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's odds (not a number without words), and the shares of its words in them."""
    top = np.full(texts, -np.inf)
    np.maximum.at(top, doc, odds)
    share = times * np.exp(odds - top[doc])
    share /= np.bincount(doc, weights=share, minlength=texts)[doc]
    pooled = np.bincount(doc, weights=share * odds, minlength=texts)
    pooled[np.bincount(doc, minlength=texts) == 0] = np.nan
    return pooled, share


def _gradients(
    bags: _Bags, bucket: np.ndarray, cut: np.ndarray, vectors: np.ndarray, wrong: np.ndarray, words: np.ndarray, pooled: np.ndarray, share: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of the sum of ``wrong`` times each text's odds: by every subword's odds, and by the softmax's direction.

    ``words`` are the words' odds; a word's share grows with its odds, which the second factor is for.
    """
    count = np.diff(cut)
    pull = wrong[bags.doc] * share * (1 + words[bags.word] - np.nan_to_num(pooled)[bags.doc])
    by_word = np.bincount(bags.word, weights=pull, minlength=len(count)) / count
    slope = np.bincount(bucket, weights=np.repeat(by_word, count), minlength=len(vectors))
    return slope, slope @ vectors


def fit(texts: list[str], labels: list[int], epochs: int = 60, rate: float = 1.0, decay: float = 1e-4) -> bytes:
    """Slope, offset, odds of a text without words, and every subword's odds, as float32.

    Embeddings start along the softmax's direction by how unevenly labels share a subword, then
    both are trained by full-batch gradients with Adagrad steps; a fifth of the texts is kept to
    choose the epoch and to set slope and offset.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        odds = np.log((share + 0.01) / (1.01 - share))
        return np.concatenate([[0, odds, 0], np.zeros(1 << BITS)]).astype(np.float32).tobytes()
    bags = _Bags(pa.array(texts, pa.string()))
    bucket, cut = bags.subwords()
    count = np.diff(cut)
    # in how many texts of each label a subword occurs; a word's texts are counted once for each word
    hits = [np.bincount(bags.word, weights=(y[bags.doc] == k), minlength=len(bags.room)).astype(np.float32) for k in (0, 1)]
    seen = [np.bincount(bucket, weights=np.repeat(hits[k], count), minlength=1 << BITS) for k in (0, 1)]
    prior = y.mean()
    expected = (seen[0] + seen[1]) * prior
    start = np.log((seen[1] + 4 * prior + 0.5) / (expected + 4 * prior + 0.5)) - np.log((seen[0] + 4 * (1 - prior) + 0.5) / (seen[0] + seen[1] - expected + 4 * (1 - prior) + 0.5))
    rng = np.random.Generator(np.random.PCG64(7))
    softmax = rng.normal(0, 0.5, (2, WIDTH))
    direction = softmax[1] - softmax[0]
    vectors = rng.normal(0, 0.01, (1 << BITS, WIDTH)) + np.outer(start, direction / (direction @ direction))
    grown, grown_softmax, offset = np.full((1 << BITS, WIDTH), 1e-6), np.full((2, WIDTH), 1e-6), -1.0
    tuning = rng.random(len(y)) < 0.2
    weight = np.where(y == 1, 0.5 / prior, 0.5 / (1 - prior)) * ~tuning
    mean_odds = lambda: np.add.reduceat((vectors @ (softmax[1] - softmax[0]))[bucket], cut[:-1]) / count
    best: tuple[float, np.ndarray] = np.inf, np.concatenate([[0.0, 0.0, -4.0], np.zeros(1 << BITS)])
    for epoch in range(epochs + 1 if len(count) else 0):
        words = mean_odds()
        pooled, share = _pooled(bags.doc, bags.times, words[bags.word], len(y))
        if epoch % 5 == 0:
            loss, slope, at_zero = _calibrated(pooled, y, tuning)
            if loss < best[0]:
                best = loss, np.concatenate([[slope, at_zero, -4.0], vectors @ (softmax[1] - softmax[0])])
        odds = np.nan_to_num(pooled) + offset
        wrong = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) * weight
        offset -= 0.5 * wrong.sum() / weight.sum()
        direction = softmax[1] - softmax[0]
        slope, toward = _gradients(bags, bucket, cut, vectors, wrong / len(y), words, pooled, share)
        gradient = np.outer(slope, direction) + decay / len(y) * vectors * (slope != 0)[:, None]
        grown += gradient**2
        vectors -= rate * 0.1 * gradient / np.sqrt(grown) * (slope != 0)[:, None]
        for k, sign in ((0, -1), (1, 1)):
            grown_softmax[k] += toward**2
            softmax[k] -= rate * 0.01 * sign * toward / np.sqrt(grown_softmax[k])
    return best[1].astype(np.float32).tobytes()


def _calibrated(odds: np.ndarray, y: np.ndarray, tuning: np.ndarray) -> tuple[float, float, float]:
    """Loss, slope and offset of a logistic regression on the odds of the texts kept for it (of all, if these have one label)."""
    known = ~np.isnan(odds)
    at = known & tuning if len(set(y[known & tuning])) == 2 else known
    mean = odds[at].mean() if at.any() else 0.0
    slope, offset = _logistic(odds[at] - mean, y[at])
    signed = (slope * (odds[at] - mean) + offset) * (2 * y[at] - 1)
    return float(np.logaddexp(0, -signed).sum()), slope, offset - slope * mean


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one number, lightly regularised (Newton steps)."""
    scale = x.std() + 1e-9
    x = x / scale
    w = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2) * 0.05
        w -= np.linalg.solve(hessian, design.T @ (p - y) + 0.05 * w)
    return w[0] / scale, w[1]


def scores(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    slope, offset, wordless = (float(x) for x in model[:3])
    bags = _Bags(texts)
    odds = _pooled(bags.doc, bags.times, bags.odds(model[3:])[bags.word].astype(np.float64), bags.texts)[0]
    value = np.where(np.isnan(odds), wordless if slope else offset, slope * np.nan_to_num(odds) + offset)
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label_column: str = "toxic",
    rows_each: int = 3000,
    id_column: str = "doc_id",
    text_column: str = "text",
    untrained: float | None = None,
) -> DataFrame:
    """Columns of ``docs`` and ``score`` (0 to 1, higher: label 1 likelier), which replaces such a column.

    The model is learnt from at most ``rows_each`` labelled texts of each label for which
    ``usable`` (a condition on ``labels``) holds, and scores every whole text inside its task;
    nothing is shuffled. Its only input is the text. Null, empty and wordless texts get a fixed
    low score. Without labels of both kinds every score is ``untrained``, if given, else about the share of label 1
    (0.5 without any). No rows in, no rows out.
    """
    model = learning.trained(docs, labels, label_column, usable, fit, rows_each, id_column, text_column)
    if untrained is not None and not np.frombuffer(model, np.float32)[3:].any():
        odds = np.log(max(untrained, 1e-12) / max(1 - untrained, 1e-12))
        model = np.concatenate([[0, odds], np.zeros((1 << BITS) + 1)]).astype(np.float32).tobytes()
    return scored(docs, scores, model, text_column)
