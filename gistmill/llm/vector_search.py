"""Exact top-k by inner product with vector-approximation files: quantised cells first, exact vectors in bound order."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm import tables

CELLS = 256
_EXACT = 1 << 53


def _integer_vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(scale * x) of the usable vectors of a batch, by dimension."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    values = np.floor(scale * np.asarray(flat.cast(pa.float64()).fill_null(np.nan)))
    begin = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = (bad[begin + sizes] == bad[begin]) & np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
    numbers = np.asarray(ids.fill_null(0))
    for size in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == size))
        yield numbers[rows], values[begin[rows][:, None] + np.arange(size)]


def _blocks(vectors: DataFrame, scale: int, rows: int) -> DataFrame:
    """Vectors of one dimension packed into blocks: number, dimension, ids and exact values (as doubles)."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held = TaskContext.get().partitionId() << 32, 0, {}

        def emit(size: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(size)))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([base + number], pa.int64()), "size": pa.array([size], pa.int32()),
                "ids": pa.array([ids.tobytes()]), "exact": pa.array([values.tobytes()]),
            })

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for ids, values in _integer_vectors(batch.slice(at, rows), scale):
                    size = values.shape[1]
                    held.setdefault(size, []).append((ids, values))
                    if sum(len(x) for x, _ in held[size]) >= rows:
                        yield emit(size)
                        number += 1
        for size in list(held):
            yield emit(size)
            number += 1

    return tables.in_arrow(vectors, block, "block long, size int, ids binary, exact binary")


def _narrow(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers held as doubles, in the narrowest type that holds them: the type and the bytes."""
    low, high = values.min(initial=0), values.max(initial=0)
    kind = next((x for x in ("<i2", "<i4") if np.iinfo(x).min <= low and high <= np.iinfo(x).max), "<f8")
    return kind, values.astype(kind).tobytes()


def _cells(blocks: DataFrame) -> DataFrame:
    """The approximation of each block: distinct vectors, by their smallest id, in cells of one byte a dimension.

    ``origin`` and ``step`` bound the values of a cell; ``ids`` holds the distinct ids of equal vectors
    together, ascending, ``counts`` how many. ``exact`` is a column of its own, which scans of cells don't read.
    """

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                exact = np.frombuffer(row["exact"], np.float64).reshape(len(ids), row["size"])
                exact, of = np.unique(exact, axis=0, return_inverse=True)
                least = np.full(len(exact), np.iinfo(np.int64).max)
                np.minimum.at(least, of.ravel(), ids)
                order = np.argsort(least, kind="stable")
                exact, slot = exact[order], np.argsort(order)[of.ravel()]
                owned = np.unique(np.stack([slot, ids], axis=1), axis=0)
                origin = exact.min(axis=0)
                step = np.floor((exact.max(axis=0) - origin) / CELLS) + 1
                cells = np.floor((exact - origin) / step).astype(np.uint8)
                kind, packed = _narrow(exact)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]], pa.int64()), "size": pa.array([row["size"]], pa.int32()),
                    "ids": pa.array([np.ascontiguousarray(owned[:, 1]).tobytes()]),
                    "counts": pa.array([np.bincount(owned[:, 0], minlength=len(exact)).tobytes()]),
                    "origin": pa.array([origin.tobytes()]), "step": pa.array([step.tobytes()]), "cells": pa.array([cells.tobytes()]),
                    "kind": pa.array([kind]), "exact": pa.array([packed]),
                })

    return tables.in_arrow(
        blocks, approximate,
        "block long, size int, ids binary, counts binary, origin binary, step binary, cells binary, kind string, exact binary",
    )


def _bounds(row: dict, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest scores that queries (a row each) may have with the vectors of a block (a column each)."""
    size = row["size"]
    origin, step = np.frombuffer(row["origin"], np.float64), np.frombuffer(row["step"], np.float64)
    cells = np.frombuffer(row["cells"], np.uint8).reshape(len(row["counts"]) // 8, size)
    # a value lies between origin + cell * step and step - 1 above that
    floor = (queries @ origin)[:, None] + (queries * step) @ cells.T.astype(np.float64)
    # rounding of bounds beyond 2^53
    slack = (np.abs(queries) @ np.maximum(np.abs(origin), np.abs(origin + CELLS * step))) * (size + 4) * 2.0**-52
    slack = np.where(slack < 0.5, 0, slack)
    return (
        floor + (np.minimum(queries, 0) @ (step - 1) - slack)[:, None],
        floor + (np.maximum(queries, 0) @ (step - 1) + slack)[:, None],
    )


def _near(lowest: np.ndarray, highest: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and slots of a block that may be among its ``k`` best.

    ``first``: slots whose smallest id no earlier slot has. ``k + 1`` of these that are certain to be better rule a slot out
    (one of them may be the query itself), also if they are as good and before it, that is of smaller ids.
    """
    if first.sum() <= k:
        return np.nonzero(np.ones(lowest.shape, bool))
    rivals = np.where(first, lowest, -np.inf)
    certain = np.partition(rivals, -k - 1, axis=1)[:, -k - 1][:, None]
    keep = highest > certain
    tied = np.flatnonzero(((highest == certain) & ~keep).any(axis=1))
    if len(tied):
        level = certain[tied]
        better = (rivals[tied] > level).sum(axis=1)[:, None]
        ahead = np.cumsum(rivals[tied] == level, axis=1, dtype=np.int32)
        last = (ahead >= k + 1 - better).argmax(axis=1)[:, None]
        keep[tied] |= (highest[tied] == level) & (np.arange(highest.shape[1]) <= last)
    return np.nonzero(keep)


_CANDIDATE = (
    ("query_block", "long"), ("place", "int"), ("query_id", "long"), ("block", "long"), ("slot", "int"), ("vec_id", "long"),
    ("lower", "double"), ("upper", "double"),
)
_CANDIDATES = ", ".join(" ".join(x) for x in _CANDIDATE)


def _kept(query: np.ndarray, vec_id: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """Which candidates aren't ruled out by ``k`` other ids of their query that are certain to be better."""
    order = np.lexsort((-lower, vec_id, query))
    new = np.ones(len(order), bool)
    new[1:] = (query[order][1:] != query[order][:-1]) | (vec_id[order][1:] != vec_id[order][:-1])
    order = order[new]
    order = order[np.lexsort((vec_id[order], -lower[order], query[order]))]
    begin = np.searchsorted(query[order], np.arange(query.max(initial=-1) + 2))
    full = np.flatnonzero(np.diff(begin) >= k)
    bound, bound_id = np.full(len(begin), -np.inf), np.full(len(begin), np.iinfo(np.int64).max)
    at = order[begin[full] + k - 1]
    bound[full], bound_id[full] = lower[at], vec_id[at]
    return (upper > bound[query]) | ((upper == bound[query]) & (vec_id <= bound_id[query]))


def _scan(files: pa.Table, asked: pa.Table, k: int) -> Iterator[pa.Table]:
    """For each block of queries, what may be among the ``k`` best of these blocks of vectors, by cells alone."""
    rows = files.to_pylist()
    for block in rows:
        ids, counts = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["counts"], np.int64)
        begin = np.cumsum(counts) - counts
        block["least"], block["several"] = ids[begin], counts > 1
        block["second"] = ids[np.minimum(begin + 1, len(ids) - 1)]
        block["first"] = np.append(True, block["least"][1:] != block["least"][:-1])
    for query in asked.to_pylist():
        query_ids = np.frombuffer(query["query_ids"], np.int64)
        queries = np.frombuffer(query["queries"], np.float64).reshape(len(query_ids), query["size"])
        parts = []
        for block in rows:
            lowest, highest = _bounds(block, queries)
            q, slot = _near(lowest, highest, block["first"], k)
            own = block["least"][slot] == query_ids[q]
            usable = ~own | block["several"][slot]
            q, slot, own = q[usable], slot[usable], own[usable]
            vec_id = np.where(own, block["second"][slot], block["least"][slot])
            parts.append((q, np.full(len(q), block["block"]), slot, vec_id, lowest[q, slot], highest[q, slot]))
        q, block_of, slot, vec_id, lower, upper = (np.concatenate(x) for x in zip(*parts))
        keep = _kept(q, vec_id, lower, upper, k)
        values = [np.full(len(q), query["query_block"]), q, query_ids[q], block_of, slot, vec_id, lower, upper]
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        yield pa.table({name: pa.array(x[keep], kinds[kind]) for (name, kind), x in zip(_CANDIDATE, values)})


def _products(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Inner products, row by row, of integers held as doubles; beyond 2^53 with Python's integers."""
    if left.size and np.abs(left).max() * np.abs(right).max() * left.shape[1] >= _EXACT:
        return [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(left.tolist(), right.tolist())]
    return np.einsum("ij,ij->i", left, right).astype(np.int64).tolist()


def _read(files: DataFrame, asked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Exact scores (query_id, vec_id, score) of the candidates ``wanted``; only their vectors leave their blocks.

    A vector that very many queries want is asked for once by each block of queries.
    """
    slots = wanted.groupBy("block").agg(F.collect_set("slot").alias("slots"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64)
                end = np.cumsum(counts)
                exact = np.frombuffer(row["exact"], row["kind"]).reshape(len(counts), row["size"])
                chosen = np.sort(row["slots"])
                # a query's own id aside, the k smallest of equal vectors' ids are all that can be reported
                own = [ids[b - c:min(b, b - c + k + 1)].tobytes() for b, c in zip(end[chosen], counts[chosen])]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([row["block"]] * len(chosen), pa.int64()), "slot": pa.array(chosen, pa.int32()),
                    "own": pa.array(own, pa.binary()), "exact": pa.array([x.astype(np.float64).tobytes() for x in exact[chosen]], pa.binary()),
                })

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("exact")])
            for size in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                left, right = (
                    np.frombuffer(b"".join(rows.column(c).to_pylist()), np.float64).reshape(rows.num_rows, size // 8) for c in ("exact", "vector")
                )
                found = [
                    (query_id, vec_id, value)
                    for query_id, own, value in zip(rows.column("query_id").to_pylist(), rows.column("own").to_pylist(), _products(left, right))
                    for vec_id in np.frombuffer(own, np.int64).tolist() if vec_id != query_id
                ]
                yield pa.RecordBatch.from_pydict({
                    name: pa.array([x[place] for x in found], pa.int64()) for place, name in enumerate(("query_id", "vec_id", "score"))
                })

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, width = np.frombuffer(row["query_ids"], np.int64), 8 * row["size"]
                yield pa.RecordBatch.from_pydict({
                    "query_block": pa.array([row["query_block"]] * len(ids), pa.int64()), "place": pa.array(range(len(ids)), pa.int32()),
                    "query_id": pa.array(ids), "vector": pa.array([row["queries"][i * width:(i + 1) * width] for i in range(len(ids))], pa.binary()),
                })

    read = tables.in_arrow(
        files.select("block", "size", "ids", "counts", "kind", "exact").join(slots, "block"), pick, "block long, slot int, own binary, exact binary"
    )
    asking = wanted.groupBy("query_block", "block", "slot").agg(F.collect_set("place").alias("places"))
    met = asking.join(read, ["block", "slot"]).select("query_block", F.explode("places").alias("place"), "own", "exact")
    vectors = tables.in_arrow(asked, rows_of, "query_block long, place int, query_id long, vector binary")
    return tables.in_arrow(met.join(vectors, ["query_block", "place"]), score, "query_id long, vec_id long, score long").distinct()


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _reaching(candidates: DataFrame, bounds: DataFrame) -> DataFrame:
    """Candidates whose upper bound reaches their query's ``bound`` (and ``bound_id``), if it has one."""
    beats = (F.col("upper") > F.col("bound")) | ((F.col("upper") == F.col("bound")) & (F.col("vec_id") <= F.col("bound_id")))
    return candidates.join(bounds, "query_id", "left").filter(F.col("bound").isNull() | beats).drop("bound", "bound_id")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block_rows: int = 4096, query_rows: int = 512,
    stripe_blocks: int = 64, group_blocks: int = 16,
) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) that ``is_query`` names, the ``k`` rows of highest inner product.

    Components x become floor(scale * x). Vectors are packed into blocks with an approximation file
    each: cells of one byte a dimension. Stripes of blocks meet groups of query blocks, and all cells, nothing else, are
    scanned for bounds of the scores. Over all stripes a query's k-th lower bound rules out what can't reach it. Then exact vectors
    are read by block and slot, in the order of upper bounds: the first k of each query, and of the
    rest those whose upper bound reaches the k-th exact score of these, after which the k-th result is certain. Equal
    vectors of a block are scanned once, so that a very common vector costs no more than others.

    Returns query_id, rank (from 1), vec_id, score (long), by score, ties to the smaller vec_id.
    Rows with a null id, or a vector that is null or has null or non-finite components, take no part. A query is never its own
    candidate. Only vectors of equal length are compared; empty vectors score 0. Repeated rows count
    once. A score beyond a long raises. No rows in, no rows out.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    files = tables.stored(_cells(_blocks(own, scale, block_rows)))
    asked = tables.stored(
        _blocks(own.filter(is_query), scale, query_rows)
        .select(F.col("block").alias("query_block"), "size", F.col("ids").alias("query_ids"), F.col("exact").alias("queries"))
    )
    stripes, groups = (max(1, -(-side.count() // most)) for side, most in ((files, stripe_blocks), (asked, group_blocks)))
    keys = ["size", "stripe", "group"]
    numbers = {name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for name, n in (("stripe", stripes), ("group", groups))}
    cells = files.drop("kind", "exact").withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes))).withColumn("group", numbers["group"])
    queries = asked.withColumn("group", F.pmod(F.xxhash64("query_block"), F.lit(groups))).withColumn("stripe", numbers["stripe"])

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_scan(left, right, k)) if left.num_rows and right.num_rows else []
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        empty = pa.table({name: pa.array([], kinds[kind]) for name, kind in _CANDIDATE})
        return pa.concat_tables([empty, *found])

    candidates = tables.stored(cells.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(scan, _CANDIDATES))
    certain = candidates.groupBy("query_id", "vec_id").agg(F.max("lower").alias("score"))
    bounds = _best(certain, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"), F.col("vec_id").alias("bound_id"))
    reaching = tables.stored(_reaching(candidates, bounds), narrow=True)
    # read at once: the k of the highest upper bounds; a window that limits groups before the shuffle, as a query may have many candidates
    order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "block", "slot", "query_block", "place")
    turn = F.row_number().over(order)
    first = tables.stored(reaching.withColumn("turn", turn).filter(F.col("turn") <= k).drop("turn"), narrow=True)
    head = tables.stored(_read(files, asked, first, k), narrow=True)
    score = F.col("score").cast("double")
    # a score beyond 2^53 is rounded as a double
    low = F.when(F.abs(score) < float(_EXACT), score).otherwise(score - F.abs(score) * 2.0**-51)
    scored = _best(head, k).filter(F.col("rank") == k).select("query_id", low.alias("bound"), F.col("vec_id").alias("bound_id"))
    later = _reaching(reaching, scored).join(first, ["query_block", "place", "block", "slot"], "left_anti")
    tail = _read(files, asked, later, k)
    return _best(head.union(tail).distinct(), k).select("query_id", "rank", "vec_id", "score")
