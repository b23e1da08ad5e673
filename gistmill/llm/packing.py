"""Packing token sequences into as few training sequences as possible.

The lengths' histogram, at most one row for each possible length, is all the driver sees. A
linear program over configurations (multisets of lengths that fit a sequence) is solved by
multiplicative weights, priced by dynamic programming over the capacity, and rounded down;
the rest is packed by best fit, many equal sequences at a time. The plan maps (length, rank among the pieces
of that length) to a place, so pieces find theirs without meeting each other.
"""

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm import tables
from gistmill.llm.bpe import encoded
from gistmill.llm.words import slices

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def price(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each room, and the length taken first (0: a token is left empty).

    ``weights[l]`` is the value of a piece of length ``l`` (-inf: there is none). Of equal values the longest is taken.
    """
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        values = best[:room] + weights[room:0:-1]
        k = int(values.argmax())
        if values[k] > best[room - 1]:
            best[room], choice[room] = values[k], room - k
        else:
            best[room] = best[room - 1]
    return best, choice


def _configurations(seeds: np.ndarray, choice: np.ndarray, capacity: int) -> np.ndarray:
    """For each seed the lengths of its best configuration, as one row padded with 0."""
    columns, room = [seeds], capacity - seeds
    while True:
        taken = choice[room]
        while (stuck := (taken == 0) & (room > 0)).any():
            room = np.where(stuck, room - 1, room)
            taken = choice[room]
        if not taken.any():
            return np.stack(columns, axis=1)
        columns.append(taken)
        room = room - taken


def solve(counts: np.ndarray, capacity: int, rate: float = 1.0, memory: float = 0.9) -> tuple[dict, float]:
    """Fractional uses of configurations that cover ``counts`` about evenly, and a lower bound on the sequences.

    In each round every length (of a few lengths, those whose configurations are worth most) seeds its
    best configuration; lengths lately covered less than their share get heavier, others lighter, by
    smaller steps from round to round. The best value scales the
    weights to a feasible dual, whose value is the bound. Uses are means over the last two thirds of the rounds.
    """
    lengths = np.flatnonzero(counts)
    n = counts[lengths].astype(float)
    weights = lengths / capacity
    uses: dict[tuple, float] = defaultdict(float)
    rounds = int(np.clip(20_000 / len(lengths), 60, 400))
    covered, bound, kept = np.zeros(len(lengths)), float(n @ weights), rounds - rounds // 3
    for turn in range(1, rounds + 1):
        by_length = np.full(capacity + 1, -np.inf)
        by_length[lengths] = weights
        best, choice = price(by_length, capacity)
        weights, best = weights / best[capacity], best / best[capacity]
        bound = max(bound, float(n @ weights))
        worth = weights + best[capacity - lengths]
        seeds = worth >= (min(1 - 0.3 / turn, np.median(worth)) if len(lengths) <= 256 else 0)
        rows = _configurations(lengths[seeds], choice, capacity)
        amount = n[seeds] / (rows == rows[:, :1]).sum(axis=1)
        amount *= (n @ lengths) / (amount @ rows.sum(axis=1))
        here = np.bincount(rows.ravel(), weights=np.repeat(amount, rows.shape[1]), minlength=capacity + 1)[lengths]
        if turn > rounds - kept:
            for row, much in zip(np.sort(rows, axis=1)[:, ::-1].tolist(), amount.tolist()):
                uses[tuple(row)] += much / kept
        covered = covered * memory + here
        share = covered / (n * (1 - memory**turn) / (1 - memory))
        weights = weights * np.exp(-rate / turn**0.5 * np.clip(share - 1, -1, 1))
    return dict(uses), bound


def _best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Longest first, each piece into the fullest sequence that has room.

    Sequences of equal content are held together with their number, and pieces of a length are placed in all of them
    at once: a sequence that got a piece is the fullest with room as long as another fits. The work depends on the lengths, not on the counts.
    """
    open_: list[list[tuple[tuple, int]]] = [[] for _ in range(capacity + 1)]
    open_[capacity] = [((), int(counts.sum()))]
    rooms = np.zeros(capacity + 1, bool)
    rooms[capacity] = True

    def put(room: int, content: tuple, times: int) -> None:
        open_[room].append((content, times))
        rooms[room] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = length + int(rooms[length:].argmax())
            content, times = open_[room].pop()
            rooms[room] = bool(open_[room])
            most = room // length
            whole = min(times, left // most)
            if whole:
                put(room - most * length, (*content, (length, most)), whole)
                left -= whole * most
            if whole < times and left:
                put(room - left * length, (*content, (length, left)), 1)
                whole, left = whole + 1, 0
            if whole < times:
                put(room, content, times - whole)
    return [(content, times) for row in open_ for content, times in row if content]


def _round(uses: dict, left: np.ndarray, taken: float) -> Plan:
    """Whole uses of about ``taken`` of the fractional ones, remainders carried on; reduces ``left``."""
    plan, carried = [], 0.0
    for row, much in sorted(uses.items()):
        carried += much * taken
        content = Counter(x for x in row if x)
        times = int(min(carried, min(left[x] // k for x, k in content.items())))
        carried = min(carried - times, 1000)
        if times:
            plan.append((tuple(sorted(content.items(), reverse=True)), times))
            for x, k in content.items():
                left[x] -= k * times
    return plan


def plan_sequences(
    counts: np.ndarray, capacity: int, shares: tuple[float, ...] = (1.0, 0.9, 0.6, 0.3, 0.0)
) -> tuple[Plan, float]:
    """Configurations ((length, copies), ...) with how often each is used, and a lower bound on the sequences.

    ``counts[l]``: pieces of length ``l``. The linear program is solved and rounded taking each of ``shares`` of its uses;
    what that leaves is packed by best fit, at once and after a second program for it, and the plan of fewest sequences
    wins. A share of 0 is best fit alone, so that the plan never loses to it. Counts of any size take the same steps.
    """
    counts = counts.copy()
    full, counts[capacity] = int(counts[capacity]), 0
    whole: Plan = [(((capacity, 1),), full)] if full else []
    if not counts.any():
        return whole, float(full)
    uses, bound = solve(counts, capacity)
    bound = max(np.ceil(bound - 1e-6), np.ceil((counts @ np.arange(capacity + 1)) / capacity))
    plans = []
    for share in shares:
        left = counts.copy()
        plan = _round(uses, left, share) if share else []
        plans.append(plan + _best_fit(left, capacity))
        if 0 < share < 1 and left.any():
            second = _round(solve(left, capacity)[0], left, share)
            plans.append(plan + second + _best_fit(left, capacity))
    return whole + min(plans, key=lambda x: sum(times for _, times in x)), float(full + bound)


def _places(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each, offset of the first), sorted: a plain array, to be broadcast."""
    rows, taken, number = [], defaultdict(int), 0
    for content, times in plan:
        at = 0
        for length, copies in content:
            rows.append((length, taken[length], number, copies, at))
            taken[length] += copies * times
            at += length * copies
        number += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(places: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their rank among those of their length."""
    k = np.searchsorted(places[:, 0] << 40 | places[:, 1], length << 40 | rank, side="right") - 1
    _, first, number, copies, at = places[k].T
    return number + (rank - first) // copies, at + (rank - first) % copies * length


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 4 << 20):
            _, ids, cuts = encoded(batch, text_column, path)
            counts = np.diff(cuts) + 1
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            with_end = np.insert(ids, cuts[1:], end_id).astype("<u4")
            begin = (np.cumsum(counts) - counts)[row] + start
            body = memoryview(with_end)
            crc = [zlib.crc32(body[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column).take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return tables.in_arrow(docs.select(id_column, text_column), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_sequences(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Place all documents' tokens in as few sequences of at most ``capacity`` tokens as the plan finds.

    Tokens are those of the vocabulary file at ``path``, then ``end_id``. Longer documents are cut into
    pieces of ``capacity``. Returns a row for each piece: doc_id, piece (from 0), start, length,
    ids_crc32, sequence_id and offset, which have no gaps within a sequence.

    Pieces are numbered within their length in buckets of hashed ids, lifted by the counts of
    earlier buckets, so that a very common length is numbered in many tasks. The plan is
    broadcast; its size depends on the capacity, not on the corpus.

    Null or empty text is one piece with ``end_id`` alone. Null and repeated ids are kept: every
    row is packed. No rows in, no rows out.
    """
    pieces = tables.stored(cut_pieces(docs, path, capacity, end_id, id_column, text_column))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    places = docs.sparkSession.sparkContext.broadcast(_places(plan_sequences(counts, capacity)[0]))
    buckets = max(tables.partitions(docs), int(counts.sum()) // 100_000 + 1)
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lifts = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    lifts = lifts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lift"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = placed.withColumn("own", F.row_number().over(own) - 1).join(lifts, ["length", "bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, at = _place(places.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield tables.replaced(batch, sequence_id=pa.array(number), offset=pa.array(at)).select(
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("lift")).alias("rank"))
    return tables.in_arrow(
        ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
