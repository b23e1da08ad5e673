"""Numbers of words from a sorted array of hashes, for whole Arrow batches at a time.

A table is a tuple of plain arrays (sorted hashes, the words' bytes and where they begin, numbers, multiplier), so that it can be
broadcast as it is. Distinct words of a batch are found by Arrow, hashed and searched for together, and a
hit counts only if its bytes agree.
"""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]
_FIRST_MULTIPLIER = 0x9E3779B97F4A7C15
PIECE_BYTES, PIECE_ROWS = 1 << 21, 1 << 13


def spans(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after another, and where each begins and the last ends."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    body = words.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(cuts) - 1, values.dtype)
    full = np.diff(cuts) > 0
    if full.any():
        out[full] = np.add.reduceat(values, cuts[:-1][full])
    return out


def hashes(data: np.ndarray, cuts: np.ndarray, multiplier: int) -> np.ndarray:
    """64-bit polynomial hashes of byte spans that follow each other."""
    size = np.diff(cuts)
    powers = np.full(int(size.max(initial=0)) + 1, multiplier, np.uint64)
    powers[0] = 1
    place = np.arange(len(data)) - np.repeat(cuts[:-1], size)
    mixed = _sums((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[place], cuts)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def build(words: pa.Array, numbers: np.ndarray) -> Table:
    """The table of distinct words; a multiplier is chosen for which no two share a hash."""
    data, cuts = spans(words)
    multiplier = _FIRST_MULTIPLIER
    while True:
        found = hashes(data, cuts, multiplier)
        order = np.argsort(found, kind="stable")
        ordered = found[order]
        if not (ordered[1:] == ordered[:-1]).any():
            break
        if multiplier > _FIRST_MULTIPLIER + 64:
            raise ValueError("a word occurs twice in the table")
        multiplier += 2
    data, cuts = spans(words.take(pa.array(order)))
    return ordered, data, cuts, np.asarray(numbers, np.int64)[order], multiplier


def find(words: pa.Array, table: Table, missing: int) -> np.ndarray:
    """The number of each word, ``missing`` for one that the table lacks."""
    ordered, data, cuts, numbers, multiplier = table
    own, begin = spans(words)
    if not len(ordered) or not len(words):
        return np.full(len(words), missing, np.int64)
    hashed = hashes(own, begin, multiplier)
    at = np.minimum(np.searchsorted(ordered, hashed), len(ordered) - 1)
    size = np.diff(begin)
    hit = (ordered[at] == hashed) & (np.diff(cuts)[at] == size)
    # bytes of hits, compared in one go
    chosen = np.flatnonzero(hit)
    lengths = size[chosen]
    edges = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
    differ = data[place + np.repeat(cuts[at[chosen]], lengths)] != own[place + np.repeat(begin[chosen], lengths)]
    hit[chosen] = _sums(differ.astype(np.int64), edges) == 0
    return np.where(hit, numbers[at], missing)


def pieces(batches: Iterator[pa.RecordBatch], columns: Sequence[str], most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most_bytes`` of text in ``columns`` and to ``most_rows`` rows; a longer text is alone."""
    for batch in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0)).astype(np.int64) for c in columns)
        begin = held = 0
        for row, size in enumerate(sizes.tolist()):
            if row > begin and (held + size > most_bytes or row - begin >= most_rows):
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if batch.num_rows > begin:
            yield batch.slice(begin)


def in_pieces(columns: Sequence[pa.Array], work: Callable[..., pa.Array], kind: pa.DataType) -> pa.Array:
    """``work`` on columns of texts, a piece of bounded bytes and rows at a time: what it needs does not grow with the batch."""
    names = [str(k) for k in range(len(columns))]
    batch = pa.RecordBatch.from_arrays(list(columns), names)
    done = [work(*piece.columns).cast(kind) for piece in pieces(iter([batch]), names, PIECE_BYTES, PIECE_ROWS)]
    return pa.concat_arrays([pa.array([], kind), *done])


def split_words(texts: pa.Array, most: int | None) -> tuple[pa.Array, np.ndarray]:
    """Words of texts with single spaces between them, and where each text's begin and the last's end. Null reads as empty."""
    return _words(pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " "), most)


def split_text(texts: pa.Array, most: int | None) -> tuple[pa.Array, np.ndarray]:
    """As :func:`split_words`, of any texts: Arrow knows Unicode's 29 white space characters (a test tries them all)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        # bytes that are not UTF-8, which the JVM would replace as well
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
    return _words(pc.utf8_split_whitespace(texts), most)


def _words(lists: pa.Array, most: int | None) -> tuple[pa.Array, np.ndarray]:
    words = lists.flatten()
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    # an empty text splits into one empty word
    real = np.asarray(pc.binary_length(words)) > 0
    cuts = np.concatenate([[0], np.cumsum(counts)])
    if most is not None:
        real &= np.arange(len(words)) - np.repeat(cuts[:-1], counts) < most
    if not real.all():
        words = words.filter(pa.array(real))
        counts = _sums(real.astype(np.int64), cuts)
        cuts = np.concatenate([[0], np.cumsum(counts)])
    return words, cuts


def blocks(
    batches: Iterator[pa.RecordBatch], text: str, most: int | None, most_bytes: int, most_rows: int
) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows without their text, the first ``most`` words of each, and where each row's begin and the last's end.

    A block is filled from as many batches as it takes to have about ``most_bytes`` of words or ``most_rows`` rows.
    """
    held, size, count = [], 0, 0
    for piece in pieces(batches, [text], most_bytes, most_rows):
        words, cuts = split_text(piece.column(text), most)
        own = pc.sum(pc.binary_length(words)).as_py() or 0
        if held and (size + own > most_bytes or count + piece.num_rows > most_rows):
            yield _one_block(held)
            held, size, count = [], 0, 0
        # a copy, so that the batch with the whole texts can go
        rows = piece.drop_columns([text]).take(pa.array(np.arange(piece.num_rows)))
        held.append((rows, words, np.diff(cuts)))
        size, count = size + own, count + piece.num_rows
    if held:
        yield _one_block(held)


def _one_block(held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray]]) -> tuple[pa.RecordBatch, pa.Array, np.ndarray]:
    rows, words, counts = zip(*held)
    return pa.concat_batches(rows), pa.concat_arrays(words), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def count_words(texts: pa.Array) -> pa.Array:
    """Words of each text; null for a null."""
    counts = pa.array(np.diff(split_text(texts, None)[1]), pa.int32())
    return pc.if_else(pc.is_valid(texts), counts, pa.scalar(None, pa.int32()))


def lists_of(texts: pa.Array, table: Table, missing: int, most: int | None) -> pa.Array:
    """For each text the numbers of its words."""
    words, cuts = split_text(texts, most)
    coded = words.dictionary_encode()
    values = find(coded.dictionary, table, missing)
    flat = values[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))


def count_udf():
    """Column function: text -> number of its words, as ``functions.text.word_count`` but without a regular expression."""

    @F.arrow_udf(T.IntegerType())
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield in_pieces([texts], count_words, pa.int32())

    return counts


def number_udf(table: Broadcast, missing: int, most: int | None = None):
    """Column function: text -> numbers of its first ``most`` words, from a broadcast table."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield lists_of(texts, table.value, missing, most)

    return numbers


def broadcast_table(words: DataFrame, word: str, number: str) -> Broadcast:
    """The table of a DataFrame whose size was measured, to all executors."""
    rows = words.select(F.col(word).alias("w"), F.col(number).cast("bigint").alias("n")).toArrow()
    column = rows.column("w").combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    table = build(column.cast(pa.large_string()), rows.column("n").to_numpy())
    return words.sparkSession.sparkContext.broadcast(table)
