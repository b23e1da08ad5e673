"""ROUGE building blocks that work inside one row, so scoring needs no shuffle."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions.stem import remembering_stemmer, stem_texts
from gistmill.functions.wordtable import in_pieces, split_words


def rouge_words(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces between the words; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def word_array(words: Column) -> Column:
    return F.array_remove(F.split(words, " "), "")


def ngrams(tokens: Column, n: int) -> Column:
    """Consecutive runs of ``n`` tokens, each joined by a space."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.slice(tokens, 1, count)
    for shift in range(1, n):
        grams = F.zip_with(
            grams, F.slice(tokens, shift + 1, count), lambda left, right: F.concat_ws(" ", left, right)
        )
    return grams


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings, in one row.

    If either array has no repeated element, nothing can count twice and the
    built-in set intersection has the same size. Otherwise both are sorted and
    walked once in step. The one-element ``transform`` binds the sorted arrays to
    a name; inside the walk they would otherwise be sorted again at every step.
    """

    def walk(pair: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            a, b = F.get(pair["a"], at["i"]), F.get(pair["b"], at["j"])

            def move(i: int, j: int, hits: int) -> Column:
                return F.struct(
                    (at["i"] + i).alias("i"), (at["j"] + j).alias("j"), (at["hits"] + hits).alias("hits")
                )

            return F.when(a == b, move(1, 1, 1)).when(a < b, move(1, 0, 0)).otherwise(move(0, 1, 0))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("hits"))
        steps = F.array_repeat(F.lit(0), F.size(pair["a"]) + F.size(pair["b"]))
        return F.aggregate(steps, start, step, lambda end: end["hits"])

    def repeats_something(values: Column) -> Column:
        return F.size(F.array_distinct(values)) < F.size(values)

    in_order = F.array(F.struct(F.sort_array(left).alias("a"), F.sort_array(right).alias("b")))
    return F.when(
        repeats_something(left) & repeats_something(right), F.transform(in_order, walk)[0]
    ).otherwise(F.size(F.array_intersect(left, right)))


def precision(hits: Column, predicted: Column) -> Column:
    return F.when(predicted > 0, hits.cast("double") / predicted).otherwise(F.lit(0.0))


def f_measure(hits: Column, predicted: Column, expected: Column) -> Column:
    """Harmonic mean of hits/predicted and hits/expected; 0 without hits."""
    return F.when(hits > 0, F.lit(2.0) * hits / (predicted + expected)).otherwise(F.lit(0.0))


def _long_lcs(left: list[int], right: list[int]) -> int:
    """Bit-parallel longest common subsequence: one big-integer step per word of ``right``."""
    places: dict[int, int] = {}
    for position, word in enumerate(left):
        places[word] = places.get(word, 0) | 1 << position
    everything = (1 << len(left)) - 1
    free = everything
    for word in right:
        matched = free & places.get(word, 0)
        free = ((free + matched) | (free - matched)) & everything
    return len(left) - free.bit_count()


def _gathered(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the chosen texts one after another, each one's text, and its place there."""
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return codes[begin[text] + place], text, place


def lcs_lengths(left: pa.Array, right: pa.Array) -> np.ndarray:
    """LCS lengths, in words, of two arrays of texts with single spaces.

    Pairs whose shorter text has at most 64 words take their bit-parallel steps together: step k of all pairs is a few
    operations on one array of 64-bit masks. Others take theirs one by one, on integers of any length.
    """
    (words_l, cuts_l), (words_r, cuts_r) = split_words(left, None), split_words(right, None)
    codes = np.asarray(pa.concat_arrays([words_l, words_r]).dictionary_encode().indices).astype(np.int64)
    begin = [cuts_l[:-1], cuts_r[:-1] + len(words_l)]
    size = [np.diff(cuts_l), np.diff(cuts_r)]
    swap = size[0] > size[1]
    (short, long), (few, many) = ((np.where(swap, x[1], x[0]), np.where(swap, x[0], x[1])) for x in (begin, size))
    out = np.zeros(len(left), np.int32)
    for k in np.flatnonzero(few > 64).tolist():
        out[k] = _long_lcs(*(codes[x:x + n].tolist() for x, n in ((short[k], few[k]), (long[k], many[k]))))
    # longest first: pairs that still have a word at a step are the first ones
    fast = np.flatnonzero((few > 0) & (few <= 64))
    fast = fast[np.argsort(-many[fast], kind="stable")]
    if not len(fast):
        return out
    most = int(codes.max()) + 1
    code, pair, place = _gathered(codes, short[fast], few[fast])
    keys, bits = pair * most + code, np.uint64(1) << place.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    known, first = np.unique(keys[order], return_index=True)
    places = np.bitwise_or.reduceat(bits[order], first)
    code, pair, _ = _gathered(codes, long[fast], many[fast])
    asked = pair * most + code
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    matches = np.where(known[at] == asked, places[at], np.uint64(0))
    starts = np.cumsum(many[fast]) - many[fast]
    everything = ~np.uint64(0) >> (64 - few[fast]).astype(np.uint64)
    free = everything.copy()
    active = np.searchsorted(-many[fast], -np.arange(int(many[fast].max())), side="left")
    for step, n in enumerate(active.tolist()):
        matched = free[:n] & matches[starts[:n] + step]
        free[:n] = ((free[:n] + matched) | (free[:n] - matched)) & everything[:n]
    out[fast] = few[fast] - np.bitwise_count(free)
    return out


@F.arrow_udf(T.IntegerType())
def lcs_length(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """LCS length of two columns of space-separated words, counted in words."""
    for pair in batches:
        yield in_pieces(pair, _lcs_array, pa.int32())


def _lcs_array(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(lcs_lengths(left, right), pa.int32())


_STEMMED = T.StructType([T.StructField("pred", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("lcs", T.IntegerType())])


@F.arrow_udf(_STEMMED)
def stemmed_pair(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Both texts stemmed, and the LCS length of the stems: one pass, so one Python worker a task."""
    stem, kind = remembering_stemmer(), pa.struct([("pred", pa.string()), ("ref", pa.string()), ("lcs", pa.int32())])

    def work(left: pa.Array, right: pa.Array) -> pa.Array:
        left, right = stem_texts(left, stem), stem_texts(right, stem)
        return pa.StructArray.from_arrays([left, right, _lcs_array(left, right)], fields=list(kind))

    for pair in batches:
        yield in_pieces(pair, work, kind)
