"""Totals of values over all blocks, told back to every block that has them.

Every block of rows has distinct 64-bit keys, each with a count, and learns each key's total over all blocks (up
to 255). Keys are dealt by their upper bits to at most ``routes`` routes, so that a block sends at most that many messages
however large the corpus is. If what a route gets is too much for one task, its askers are dealt into buckets, which add up what they have and
ask ``subs`` parts of the route; the answers go back the same way. A key that every block has is asked about once
for each block, then once for each bucket.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import tables

MOST, MOST_ROUTES, TASK_BYTES = 255, 1024, 32 << 20


def layout(n_bytes: int, partitions: int, share: float) -> tuple[int, int, int]:
    """(routes, buckets, subs), powers of two, for ``share`` times ``n_bytes`` of messages."""
    up = lambda x: 1 << max(0, int(np.ceil(np.log2(max(x, 1)))))
    routes = min(MOST_ROUTES, max(up(partitions), up(n_bytes * share / (TASK_BYTES // 4))))
    buckets = up(n_bytes * share / routes / TASK_BYTES)
    return routes, buckets, min(MOST_ROUTES, buckets)


def _short(keys: np.ndarray, routes: int) -> tuple[np.ndarray, np.ndarray]:
    """Route of each key and the 32 bits that follow the route's."""
    bits = np.uint64(routes.bit_length() - 1)
    route = (keys >> (np.uint64(64) - bits)).astype(np.int64) if routes > 1 else np.zeros(len(keys), np.int64)
    return route, (keys >> (np.uint64(32) - bits)).astype(np.uint32)


def _message(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return keys.astype("<u4").tobytes() + np.minimum(counts, MOST).astype(np.uint8).tobytes()


def _merged(bodies: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of messages, their totals, where each message's keys are among them, and messages' sizes."""
    keys, counts = [], []
    for body in bodies:
        data = np.frombuffer(body.as_buffer(), np.uint8)
        n = len(data) // 5
        keys.append(data[:4 * n].view("<u4"))
        counts.append(data[4 * n:])
    found, of = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(of.ravel(), weights=np.concatenate(counts)).astype(np.int64)
    return found, totals, of.ravel(), [len(x) for x in keys]


def _replies(totals: np.ndarray, of: np.ndarray, sizes: list[int]) -> list[bytes]:
    answers = np.minimum(totals, MOST).astype(np.uint8)[of]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [answers[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def with_totals(
    blocks: DataFrame,
    keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]],
    share: float = 1.0,
    plan: tuple[int, int, int] | None = None,
) -> DataFrame:
    """``blocks`` (block, n_bytes, payload) with ``answers``: (route, totals as bytes), null for a block without keys.

    ``keys_of(rows)`` gives a block's distinct keys, ascending, and their counts; :func:`totals_of` puts answers in the order of the keys.
    Keys that agree in the route and the 32 bits after it are taken for one: a total may be too large, never too small.
    ``share`` is the size of messages against that of the text; ``plan`` sets routes, buckets and subs.
    """
    if plan is None:
        plan = layout(blocks.agg(F.sum("n_bytes")).first()[0] or 0, tables.partitions(blocks), share)
    routes, buckets, subs = plan

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                keys, counts = keys_of(tables.unpack(payload.as_buffer()))
                route, short = _short(keys, routes)
                cuts = np.searchsorted(route, np.arange(routes + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({
                    "route": pa.array(full, pa.int32()), "asker": pa.array(np.full(len(full), block), pa.int64()),
                    "body": pa.array([_message(short[cuts[r]:cuts[r + 1]], counts[cuts[r]:cuts[r + 1]]) for r in full], pa.binary()),
                })

    def settle(table: pa.Table) -> pa.Table:
        _, totals, of, sizes = _merged(table.column("body"))
        return pa.table({
            "asker": table.column("asker"), "route": table.column("route"),
            "answer": pa.array(_replies(totals, of, sizes), pa.binary()),
        })

    schema = "asker long, route int, answer binary"
    asks = tables.in_arrow(blocks.select("block", "payload"), ask, "route int, asker long, body binary")
    if buckets == 1:
        answered = tables.groups_in_arrow(asks, ["route"], settle, schema)
    else:
        answered = _in_buckets(tables.stored(asks.withColumn("bucket", F.pmod(F.xxhash64("asker"), F.lit(buckets)).cast("int"))), subs, settle, schema)
    replies = answered.groupBy("asker").agg(F.collect_list(F.struct("route", "answer")).alias("answers"))
    return blocks.join(replies, F.col("block") == F.col("asker"), "left").drop("asker")


def _in_buckets(asks: DataFrame, subs: int, settle: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each bucket of a route's askers adds up first and asks the parts of the route once."""
    shift = 32 - (subs.bit_length() - 1)

    def parts_of(found: np.ndarray) -> np.ndarray:
        return np.searchsorted(found.astype(np.uint64) >> np.uint64(shift), np.arange(subs + 1))

    def add(table: pa.Table) -> pa.Table:
        found, totals, _, _ = _merged(table.column("body"))
        cuts = parts_of(found)
        full = np.flatnonzero(np.diff(cuts))
        route, bucket = table.column("route")[0].as_py(), table.column("bucket")[0].as_py()
        return pa.table({
            "part": pa.array(full + route * subs, pa.int64()), "asker": pa.array(np.full(len(full), bucket), pa.int64()), "route": pa.array(np.full(len(full), route), pa.int32()),
            "body": pa.array([_message(found[cuts[s]:cuts[s + 1]], totals[cuts[s]:cuts[s + 1]]) for s in full], pa.binary()),
        })

    def answer(asked: pa.Table, replies: pa.Table) -> pa.Table:
        found, _, of, sizes = _merged(asked.column("body"))
        cuts, totals = parts_of(found), np.zeros(len(found), np.int64)
        for part, body in zip(replies.column("part").to_pylist(), replies.column("answer")):
            totals[cuts[part % subs]:cuts[part % subs + 1]] = np.frombuffer(body.as_buffer(), np.uint8)
        return pa.table({"asker": asked.column("asker"), "route": asked.column("route"), "answer": pa.array(_replies(totals, of, sizes), pa.binary())})

    def settle_part(table: pa.Table) -> pa.Table:
        return settle(table).append_column("part", table.column("part"))

    sums = tables.groups_in_arrow(asks, ["route", "bucket"], add, "part long, asker long, route int, body binary")
    told = tables.groups_in_arrow(sums, ["part"], settle_part, f"{schema}, part long").withColumnRenamed("asker", "bucket")
    told = told.withColumn("bucket", F.col("bucket").cast("int"))
    return asks.groupBy("route", "bucket").cogroup(told.groupBy("route", "bucket")).applyInArrow(answer, schema)


def totals_of(answers: list[dict] | None) -> np.ndarray:
    """Totals of a block's keys, in the order of the keys."""
    return np.frombuffer(b"".join(x["answer"] for x in sorted(answers or [], key=lambda x: x["route"])), np.uint8)
