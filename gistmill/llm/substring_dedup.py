"""Removal of passages that an earlier document holds, by level-wise doubling of word windows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gistmill.llm import tables
from gistmill.llm.words import Words, join_words, joined_hash, mix, text_bytes, to_strings, window_hashes, window_minima

class _Windows:
    """The windows of one block, and what is asked about them: distinct seeds first, then distinct windows whose seed repeats."""

    def __init__(self, batch: pa.RecordBatch, id_column: str, text_column: str, window: int, count: int):
        self.words = Words(*text_bytes(batch.column(text_column)))
        self.ids = tables.ids_of(batch.column(id_column))
        self.count = count
        seed = (window + 1) // 2
        hashes = self.words.hashes()
        self.at = np.flatnonzero(self.words.left_in_doc() >= window)
        halves = window_hashes(hashes, seed)
        # of the seeds inside a window the smallest stands for it: equal windows have it in common
        least = window_minima(halves, window - seed + 1)[self.at]
        self.full = joined_hash(halves[:len(halves) - window + seed], halves[window - seed:])[self.at]
        self.hashes, self.window = hashes, window
        _, first, self.of = np.unique(self.full, return_index=True, return_inverse=True)
        self.doc = self.words.doc()[self.at]
        self.first = first
        self.owner = self.ids[self.doc[first]] if len(first) else np.zeros(0, np.int64)
        # what is sent of a seed: 40 bits, besides its part; the windows decide
        self.seeds, self.seed_of = np.unique(least[first], return_inverse=True)
        self.seed_order, self.seed_cuts = tables.deal(_part(self.seeds, count), count)

    def seed_questions(self) -> list[tuple[int, bytes]]:
        """For each part that gets any, five bytes of each seed."""
        low = _bytes(self.seeds[self.seed_order], 5)
        return tables.dealt_bodies(lambda a, b: low[a:b].tobytes(), self.seed_cuts)

    def extend(self, answers: list[dict] | None) -> None:
        """Deal the windows whose seed another block holds by their own hash."""
        alive = _bits(answers, self.seed_order, self.seed_cuts)[self.seed_of]
        by_place = np.argsort(self.first)
        by_place = by_place[alive[by_place]]
        order, self.cuts = tables.deal(_part(self.full[self.first[by_place]], self.count), self.count)
        self.sent = by_place[order]

    def questions(self) -> list[tuple[int, bytes]]:
        """For each part that gets any: ids as steps with run lengths, ten bytes of hashes of each window."""
        more = window_hashes(mix(self.hashes ^ _OTHER), self.window)[self.at]

        def body(a: int, b: int) -> bytes:
            chosen = self.sent[a:b]
            ids, id_runs = _runs(self.owner[chosen])
            # ids ascend, null ids (the largest) come last: steps are small
            steps = np.diff(ids.view(np.uint64))
            wide = int(len(steps) and steps.max() >= 1 << 32)
            sizes = np.array([len(ids), b - a, ids[0], wide], "<i8")
            return b"".join([
                sizes.tobytes(), steps.astype("<u8" if wide else "<u4").tobytes(), id_runs.tobytes(),
                self.full[self.first[chosen]].astype("<u8").tobytes(), _bytes(more[self.first[chosen]], 2).tobytes(),
            ])

        return tables.dealt_bodies(body, self.cuts)

    def repeated(self, answers: list[dict] | None) -> np.ndarray:
        """For each window, whether a smaller id has it, in this block or in another."""
        elsewhere = np.zeros(len(self.first), bool)
        elsewhere[self.sent] = _bits(answers, np.arange(len(self.sent)), self.cuts)
        return elsewhere[self.of] | (self.ids[self.doc] > self.owner[self.of])


#: Makes other hashes of the same words.
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _part(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(count)).astype(np.int64)


def _bytes(values: np.ndarray, size: int) -> np.ndarray:
    """The lowest bytes of each value, a row each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def _bits(answers: list[dict] | None, order: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Answered bits in the order of the items that were asked about."""
    out = np.zeros(len(order), bool)
    for entry in answers or []:
        a, b = cuts[entry["part"]], cuts[entry["part"] + 1]
        out[order[a:b]] = np.unpackbits(np.frombuffer(entry["answer"], np.uint8), count=b - a)
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and how often each follows itself, at most 255 times."""
    new = np.concatenate([[True], values[1:] != values[:-1]])
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    change = np.flatnonzero((np.arange(len(values)) - begin) % 255 == 0)
    return values[change], np.diff(np.append(change, len(values))).astype(np.uint8)


def _settle_seeds(askers: np.ndarray, bodies: list[bytes]) -> list[bytes]:
    """Which seeds several blocks hold: each block asks once about each."""
    counts = [len(np.frombuffer(body, np.uint8)) // 5 for body in bodies]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :5] = np.concatenate([np.frombuffer(body, np.uint8) for body in bodies]).reshape(-1, 5)
    seeds = wide.view("<u8").ravel()
    order = np.argsort(seeds)
    same = seeds[order][1:] == seeds[order][:-1]
    shared = np.empty(len(seeds), bool)
    shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(counts)[:-1])]


def _settle(askers: np.ndarray, bodies: list[bytes]) -> list[bytes]:
    """Of equal windows the smallest id keeps it."""
    ids, full, more, counts = [], [], [], []
    for body in bodies:
        n_ids, n, first, wide_steps = np.frombuffer(body, "<i8", 4)
        place = 32
        found = []
        for kind, size in (("<u8" if wide_steps else "<u4", n_ids - 1), ("u1", n_ids), ("<u8", n), ("<u2", n)):
            found.append(np.frombuffer(body, kind, size, place))
            place += found[-1].nbytes
        own = np.cumsum(np.concatenate([[first], found[0].astype(np.int64)]))
        ids.append(np.repeat(own, found[1]))
        full.append(found[2])
        more.append(found[3])
        counts.append(int(n))
    ids, full, more = (np.concatenate(x) for x in (ids, full, more))
    order = np.lexsort((ids, more, full))
    new = np.concatenate([[True], (full[order][1:] != full[order][:-1]) | (more[order][1:] != more[order][:-1])])
    lost = np.empty(len(ids), bool)
    lost[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return [np.packbits(x).tobytes() for x in np.split(lost, np.cumsum(counts)[:-1])]


def substring_dedup(
    docs: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True
) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Level-wise doubling in two rounds: first all seeds of half the window's length are compared, of each
    window only the one with the smallest hash; windows whose seed occurs in no other block of
    documents are done. Only the rest are extended to twice that length (the window itself), dealt by its own hash and
    compared again; what still repeats is removed. Each block sends a seed or window once, however many documents hold
    it. Whole texts and all documents take part.

    Windows are compared by 80 bits of hashes of the whole window. Returns the columns of ``docs``, of which
    the text is changed only where words go (the rest is joined by one space), and
    ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space); input
    columns of these names are replaced. ``keep_text=False`` leaves the text out.

    Null or empty text, or one shorter than the window: nothing is removed; a null stays null.
    A null id counts as larger than all others; equal ids don't remove from each other. No
    rows in, no rows out.
    """
    added = (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"))
    schema = tables.with_fields(docs.schema, *added)
    if keep_text:
        schema = tables.with_fields(schema, (text_column, "string"))
    else:
        schema.fields = [f for f in schema.fields if f.name != text_column]
    names = [f.name for f in schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    blocks = tables.packed_blocks(docs, id_column, text_column)
    count = tables.parts_for(blocks, 6 << 20, share=1.3)

    def windows(batch: pa.RecordBatch, known: list[dict] | None) -> _Windows:
        found = _Windows(batch, id_column, text_column, window, count)
        found.extend(known)
        return found

    def seeds(batch: pa.RecordBatch) -> list[tuple[int, bytes]]:
        return _Windows(batch, id_column, text_column, window, count).seed_questions()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for payload, known, answers in zip(*[rows.column(x) for x in ("payload", "known", "answers")]):
                batch = tables.unpack(payload.as_buffer())
                found = windows(batch, known.as_py())
                words = found.words
                edge = np.zeros(len(words.start) + 1, np.int64)
                hit = found.at[found.repeated(answers.as_py())]
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                kept = np.cumsum(edge[:-1]) == 0
                data, offsets = join_words(words, kept)
                n_kept = np.add.reduceat(np.append(kept, False).astype(np.int64), words.first[:-1]) * (words.counts > 0)
                columns = {
                    "n_words": pa.array(words.counts, pa.int64()),
                    "n_removed": pa.array(words.counts - n_kept, pa.int64()),
                    "kept_sha256": pa.array(tables.sha256_of(data, offsets), pa.string()),
                }
                if keep_text:
                    changed = pa.array(n_kept < words.counts)
                    columns[text_column] = pc.if_else(changed, to_strings(data, offsets), batch.column(text_column).cast(pa.string()))
                yield tables.replaced(batch, **columns).select(names)

    seeded = tables.exchange_blocks(blocks, count, seeds, _settle_seeds, keep=True).withColumnRenamed("answers", "known")
    asked = tables.exchange_blocks(seeded, count, lambda batch, known: windows(batch, known).questions(), _settle)
    return tables.in_arrow(asked, finish, schema)
