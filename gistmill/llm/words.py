"""Words of whole texts as numpy arrays, read straight from Arrow's buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. Those bytes never
occur inside a multi-byte UTF-8 character, so words are found on bytes alone. A null
text has no words.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTES = (~SPACE).astype(np.uint8)
#: White space, letters and digits (all bytes of other scripts among them), everything else.
LETTERS_AND_MARKS = np.full(256, 2, np.uint8)
LETTERS_AND_MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LETTERS_AND_MARKS[SPACE] = 0
LETTERS = np.where(LETTERS_AND_MARKS == 1, 1, 0).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_M1, _M2, _K1, _K2 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_SEGMENT = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(a * _K1 + (b ^ (b >> np.uint64(29))) * _K2)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins and the last ends. Null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    count = len(column)
    if not count:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, count + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece have about ``limit`` bytes; one longer text stands alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        begin = held = 0
        for row, size in enumerate(sizes):
            if row > begin and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if batch.num_rows > begin:
            yield batch.slice(begin)


class Words:
    """Word boundaries of a batch of texts.

    ``start`` and ``end`` are byte positions; the words of text ``d`` are those from
    ``first[d]`` to before ``first[d + 1]``. ``kinds`` gives each byte's kind: words are
    maximal runs of one kind other than 0.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORD_BYTES):
        self.data, self.offsets = data, offsets
        kind = kinds[data]
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        if len(data):
            before[0] = after[-1] = True
            np.not_equal(kind[1:], kind[:-1], out=before[1:])
            after[:-1] = before[1:]
            cuts = offsets[1:-1]
            before[cuts[cuts < len(data)]] = True
            after[cuts[cuts > 0] - 1] = True
        gap = kind == 0
        self.start = np.flatnonzero(before & ~gap)
        self.end = np.flatnonzero(after & ~gap) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, seed)

    def left_in_doc(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span; spans ascend and don't overlap."""
    table = np.random.Generator(np.random.PCG64(1000 + seed)).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)
    table |= np.uint64(1)
    size = end - start
    out = np.empty(len(start), np.uint64)
    longest = int(size.max()) if len(size) else 0
    powers = np.full(longest + 1, 0x5851F42D4C957F2D, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    for k in range(0, len(start), _SEGMENT):
        n = size[k:k + _SEGMENT]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        terms = table[data[place + np.repeat(start[k:k + _SEGMENT], n)]] * powers[place]
        out[k:k + _SEGMENT] = sums(terms, at, n)
    return mix(out + size.astype(np.uint64) * _K1)


def sums(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes; an empty group sums to 0."""
    out = np.zeros(len(size), values.dtype)
    full = size > 0
    if full.any():
        out[full] = np.add.reduceat(values, begin[full])
    return out


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` items from each position, by doubling; the last positions are missing."""
    have = 1
    while have < width and len(h):
        step = min(have, width - have)
        h = joined_hash(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width and len(h):
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def join_words(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each text joined by one space: bytes and offsets."""
    start, size = words.start[kept], (words.end - words.start)[kept]
    doc = words.doc()[kept]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    room = size + ~last
    parts = []
    for k in range(0, len(start), _SEGMENT):
        n = room[k:k + _SEGMENT]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        source = place + np.repeat(start[k:k + _SEGMENT], n)
        piece = words.data[np.minimum(source, max(len(words.data) - 1, 0))]
        piece[place == np.repeat(size[k:k + _SEGMENT], n)] = 0x20
        parts.append(piece)
    lengths = np.bincount(doc, weights=room, minlength=len(words.counts)).astype(np.int64)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def to_strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())
    ).cast(pa.string())
