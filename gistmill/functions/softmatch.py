"""F1 of best cosine matches between the words of two texts, from a columnar store of vectors.

A store is a word table and one matrix of single floats in the order of its numbers, as plain arrays, so that it can be
broadcast as it is. Pairs name vectors by number only.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gistmill.functions import wordtable

Store = tuple[wordtable.Table, np.ndarray]
BLOCK_BYTES, BLOCK_ROWS, _CELL = 1 << 20, 2048, 1024


def store(words: pa.ChunkedArray, vectors: pa.ChunkedArray) -> Store:
    """Words with a vector, numbered as they come; null vectors are left out."""
    keep = pc.and_(pc.is_valid(words), pc.is_valid(vectors))
    words, vectors = words.filter(keep), vectors.filter(keep)
    lists = vectors.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    names = pa.concat_arrays([pa.array([], pa.large_string()), *[x.cast(pa.large_string()) for x in words.chunks]])
    table = wordtable.build(names, np.arange(len(names)))
    flat = np.asarray(lists.flatten().cast(pa.float32()).fill_null(np.nan), np.float32)
    if len(names) and len(flat) % len(names) or len(set(np.asarray(lists.value_lengths()).tolist())) > 1:
        raise ValueError("vectors of different lengths")
    return table, flat.reshape(len(names), -1) if len(names) else np.zeros((0, 0), np.float32)


def pieces(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``BLOCK_BYTES`` of text and ``BLOCK_ROWS`` rows."""
    return wordtable.pieces(batches, columns, BLOCK_BYTES, BLOCK_ROWS)


def distinct_words(*texts: pa.Array) -> pa.Array:
    found = [wordtable.split_words(x, None)[0] for x in texts]
    return pc.unique(pa.concat_arrays(found)).cast(pa.string())


def f1(predictions: pa.Array, references: pa.Array, held: Store) -> list[float]:
    """Scores of pairs of texts with single spaces; 0 where neither side has a match."""
    table, matrix = held
    numbers = []
    for texts in (predictions, references):
        words, cuts = wordtable.split_words(texts, None)
        coded = words.dictionary_encode()
        found = wordtable.find(coded.dictionary, table, -1)
        numbers.append((found[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64), cuts))
    (left, left_cuts), (right, right_cuts) = numbers
    return [
        _pair(left[left_cuts[k]:left_cuts[k + 1]], right[right_cuts[k]:right_cuts[k + 1]], matrix) for k in range(len(predictions))
    ]


def _pair(left: np.ndarray, right: np.ndarray, matrix: np.ndarray) -> float:
    a, times_a = np.unique(left[left >= 0], return_counts=True)
    b, times_b = np.unique(right[right >= 0], return_counts=True)
    if not (len(a) and len(b)):
        return 0.0
    x, y = _units(matrix[a]), _units(matrix[b])
    best_x, best_y = np.empty(len(a)), np.full(len(b), -np.inf)
    for start in range(0, len(a), _CELL):
        cell = x[start:start + _CELL] @ y.T
        best_x[start:start + _CELL] = cell.max(axis=1)
        np.maximum(best_y, cell.max(axis=0), out=best_y)
    precision, recall = float(best_x @ times_a) / len(left), float(best_y @ times_b) / len(right)
    total = precision + recall
    return 2 * precision * recall / total if total else 0.0


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(float)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
