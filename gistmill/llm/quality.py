"""Quality scores: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from gistmill.llm import learning, tables
from gistmill.llm.words import LETTERS_AND_MARKS, LOWER, Words, joined_hash, mix, slices, span_hashes, sums, text_bytes

BITS = 18
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
#: A feature's value is this times its share of the text's n-grams.
SCALE = 8.0


def ngram_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each token of each text five feature numbers, and the number of tokens of each text.

    Tokens are runs of letters or of other signs. Features are hashes of the token and the pair
    of it and the next, and of one to three tokens' forms. A form is the sign itself, or for
    a word its case, its length up to 12 and whether it repeats the word before. Texts end with a
    token of their own, so that an empty text has features too.
    """
    data, offsets = text_bytes(texts)
    words = Words(data, offsets, LETTERS_AND_MARKS)
    n = len(words.start)
    plain, low = words.hashes(), span_hashes(LOWER[data], words.start, words.end)
    size = words.end - words.start
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals = upper[words.end] - upper[words.start]
    first = _UPPER[data[words.start]] if n else np.zeros(0, np.int64)
    letters = LETTERS_AND_MARKS[data[words.start]] == 1 if n else np.zeros(0, bool)
    case = np.where(capitals == 0, 0, np.where((capitals == 1) & (first == 1), 1, np.where(capitals * 2 > size, 2, 3)))
    doc = words.doc()
    same = np.zeros(n, np.int64)
    at = np.flatnonzero(letters)
    same[at[1:]] = (low[at[1:]] == low[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
    form = np.where(letters, mix((case * 64 + np.minimum(size, 12) * 2 + same).astype(np.uint64)), plain)
    # one end token for each text
    place = np.arange(n) + doc
    total = n + len(words.counts)
    tokens, forms = np.full(total, 7, np.uint64), np.full(total, 7, np.uint64)
    tokens[place], forms[place] = low, form
    ends = words.first[1:] + np.arange(len(words.counts))

    def following(x: np.ndarray) -> np.ndarray:
        x = np.append(x[1:], np.uint64(7))
        x[ends] = 7
        return x

    columns = [
        tokens, joined_hash(tokens, following(tokens)), mix(forms + np.uint64(11)),
        joined_hash(forms, following(forms)), joined_hash(joined_hash(forms, following(forms)), following(following(forms))),
    ] if total else []
    features = np.stack([mix(x + np.uint64(k)) >> np.uint64(64 - BITS) for k, x in enumerate(columns)], axis=1) if total else np.zeros((0, 5))
    return features.astype(np.int32), words.counts + 1


def fit(texts: list[str], labels: list[int], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> bytes:
    """Bias and weights as float32. FTRL-proximal: each example updates the sums z and n of its own features."""
    if not labels or min(labels) == max(labels):
        share = np.mean(labels) if labels else 0.5
        bias = np.log((share + 0.01) / (1.01 - share))
        return np.concatenate([[bias], np.zeros(1 << BITS)]).astype(np.float32).tobytes()
    examples = []
    for text, label in zip(texts, labels):
        features, count = ngram_features(pa.array([text], pa.string()))
        index, times = np.unique(features.ravel(), return_counts=True)
        examples.append((np.append(index + 1, 0), np.append(times * (SCALE / count[0]), 1.0), label))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            at, x, y = examples[k]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(len(z))).astype(np.float32).tobytes()


def scores(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text: the logistic function of its sparse dot product with the weights."""
    features, counts = ngram_features(texts)
    each = model[1:][features].sum(axis=1, dtype=np.float64)
    total = sums(each, np.cumsum(counts) - counts, counts)
    return 1 / (1 + np.exp(-np.clip(model[0] + total * SCALE / counts, -30, 30)))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    label_column: str = "quality",
    rows_each: int = 4000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Columns of ``docs`` and ``score`` (0 to 1, higher: label 1 likelier), which replaces such a column.

    The model is learnt from at most ``rows_each`` labelled texts of each label for which
    ``usable`` (a condition on ``labels``) holds, and scores every whole text inside its task;
    nothing is shuffled. Its only input is the text. Null and empty texts get the score of an
    empty text. Without labels of both kinds every score is about the share of label 1 (0.5
    without any). No rows in, no rows out.
    """
    model = learning.trained(docs, labels, label_column, usable, fit, rows_each, id_column, text_column)
    return scored(docs, scores, model, text_column)


def scored(docs: DataFrame, score, model: bytes, text_column: str) -> DataFrame:
    schema = tables.with_fields(docs.schema, ("score", "double"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(model, np.float32)
        for batch in slices(batches, text_column):
            yield tables.replaced(batch, score=pa.array(score(batch.column(text_column), weights), pa.float64()))

    return tables.in_arrow(docs, add, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))
