"""Helpers shared by these operators: written tables, packed blocks of rows, Arrow output."""

import ctypes
import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.llm.words import slices


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets one of its own, in the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, narrow: bool = False, **options: str) -> DataFrame:
    """Write once and read back: cuts the lineage and outlives lost executors.

    ``narrow``: rows are few numbers that a shuffle has brought together; a file a core is enough.
    """
    if narrow:
        df = df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    path = f"{checkpoint_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(key: tuple, make: Callable):
    """What ``make`` returns, made once in this process for each key (the last four are kept).

    Functions travel to workers by value, each time with globals of their own, so that it is held by the interpreter.
    """
    held = sys.__dict__.setdefault("_made_once", {})
    if key not in held:
        while len(held) >= 4:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _give_back() -> None:
    """Return unused memory to the system: workers live on between stages, beside a large JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _modest_batches(spark: SparkSession) -> None:
    """Batches of 8 MB to Python, unless the session has a limit of its own: both sides hold several at a time."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in modest batches, whose workers keep no memory when a partition is done."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _give_back()

    _modest_batches(df.sparkSession)
    return df.mapInArrow(mapped, schema)


def groups_in_arrow(df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """``df.groupBy(keys).applyInArrow`` in modest batches, whose workers keep no memory after a large group."""

    def applied(table: pa.Table) -> pa.Table:
        size = table.nbytes
        out = function(table)
        if size > 1 << 20:
            del table
            _give_back()
        return out

    _modest_batches(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(applied, schema)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_fields(schema: T.StructType, *added: tuple[str, str]) -> T.StructType:
    """The schema with more fields; one of the same name (in any case) is replaced."""
    names = {name.lower() for name, _ in added}
    fields = [f for f in schema.fields if f.name.lower() not in names]
    return T.StructType(fields + [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in added])


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns at the end; those of the same name (in any case) are replaced."""
    names = {name.lower() for name in columns}
    kept = [name for name in batch.schema.names if name.lower() not in names]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.names.index(name)) for name in kept] + list(columns.values()), kept + list(columns)
    )


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as 64-bit integers; a null id counts as larger than every other."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).max))


def sha256_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    body = memoryview(data)
    return [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as reader:
        return reader.read_next_batch()


def packed_blocks(
    docs: DataFrame, id_column: str, text_column: str, limit: int = 2 << 20, prepare: Callable | None = None
) -> DataFrame:
    """Rows packed into compressed blocks of about ``limit`` bytes of text, each sorted by id; written once.

    Columns: ``block`` (a number), ``n_bytes`` of text, ``payload``. The table is written,
    so every later pass sees the same blocks, whatever happens to executors. ``prepare``
    maps the batches first, in the same Python worker.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit():
            table = pa.Table.from_batches(held).combine_chunks()
            order = np.argsort(ids_of(table.column(id_column).combine_chunks()), kind="stable")
            batch = table.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=None)[0]
            return pa.RecordBatch.from_pydict({
                "block": pa.array([base + number], pa.int64()),
                "n_bytes": pa.array([size], pa.int64()),
                "payload": pa.array([pack(batch)], pa.binary()),
            })

        for piece in slices(prepare(batches) if prepare else batches, text_column, limit // 4):
            more = piece.column(text_column).nbytes
            if held and size + more > limit:
                yield emit()
                number, held, size = number + 1, [], 0
            held.append(piece)
            size += more
        if held:
            yield emit()

    # the payload is compressed already
    return stored(in_arrow(docs, blocks, "block long, n_bytes long, payload binary"), compression="none")


def deal(parts: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts items by part, ties as they were, and where each of ``count`` parts begins and the last ends."""
    order = np.argsort(parts.astype(np.uint16 if count <= 1 << 16 else np.int64), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(parts, minlength=count))])


def dealt_bodies(body_of: Callable[[int, int], bytes], cuts: np.ndarray) -> list[tuple[int, bytes]]:
    """(part, its bytes) for each part that gets something; ``body_of`` gives those of a range of dealt items."""
    full = np.flatnonzero(np.diff(cuts))
    return [(part, body_of(a, b)) for part, a, b in zip(full.tolist(), cuts[full].tolist(), cuts[full + 1].tolist())]


#: A block sends at most this many messages, however many parts there are; a task between blocks and parts gets about so many bytes.
ROUTES, TASK_BYTES = 1024, 32 << 20


def exchange_blocks(
    blocks: DataFrame,
    count: int,
    emit: Callable[..., list[tuple[int, bytes]]],
    settle: Callable[[np.ndarray, list[bytes]], list[bytes]],
    keep: bool = False,
    part_bytes: int = 8 << 20,
    routes: int = ROUTES,
) -> DataFrame:
    """One round of questions from all blocks to ``count`` parts, and the answers by block.

    ``emit(rows)`` returns (part, bytes) for each part that is asked something, by ascending part. ``settle(blocks,
    asked)`` sees all that was asked of one part and returns an answer for each block. A part
    holds hash values dealt evenly, each at most once from every block, so that frequent
    values are no larger than others. Columns: ``block``, ``payload``, ``answers`` (array of
    part and answer; null if the block asked nothing). For another round these may be asked
    again with ``answers`` renamed to ``known``, which ``emit`` gets too; ``keep`` writes the answers once for it.

    With more parts than ``routes``, neighbouring parts share a route: a block sends one message a route, askers of a route are dealt into
    buckets (of about ``TASK_BYTES``, by ``part_bytes``, the size of what a part is asked), and a bucket sends one message to each of its parts.
    Answers return the same way. So messages grow as the corpus does, not as blocks times parts. What a part sees is the same.
    """
    known = [x for x in ("known",) if x in blocks.columns]
    direct = count <= routes
    subs = -(-count // routes)
    buckets = -(-subs * part_bytes // TASK_BYTES)

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
        for batch in batches:
            for block, payload, *more in zip(batch.column("block").to_pylist(), *[batch.column(x) for x in ("payload", *known)]):
                yield block, emit(unpack(payload.as_buffer()), *[x.as_py() for x in more])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, asked in questions(batches):
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part for part, _ in asked], pa.int32()),
                "asker": pa.array([block] * len(asked), pa.int64()),
                "body": pa.array([body for _, body in asked], pa.binary()),
            })

    def ask_routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, asked in questions(batches):
            parts = np.array([part for part, _ in asked], np.int64)
            begin = np.flatnonzero(np.diff(parts // subs, prepend=-1))
            cuts = pa.array(np.append(begin, len(parts)), pa.int32())
            yield pa.RecordBatch.from_pydict({
                "route": pa.array(parts[begin] // subs, pa.int32()), "asker": pa.array([block] * len(begin), pa.int64()),
                "parts": pa.ListArray.from_arrays(cuts, pa.array(parts, pa.int32())),
                "bodies": pa.ListArray.from_arrays(cuts, pa.array([body for _, body in asked], pa.binary())),
            })

    def gather(table: pa.Table) -> pa.Table:
        """What a bucket of a route's askers asks, by part."""
        table = table.sort_by("asker").combine_chunks()
        parts, bodies = table.column("parts").combine_chunks(), table.column("bodies").combine_chunks()
        asker = np.repeat(table.column("asker").to_numpy(), np.asarray(parts.value_lengths()))
        part = parts.flatten().to_numpy()
        order = np.argsort(part, kind="stable")
        begin = np.flatnonzero(np.diff(part[order], prepend=-1))
        cuts = pa.array(np.append(begin, len(part)), pa.int32())
        return pa.table({
            "part": pa.array(part[order][begin], pa.int32()),
            "bucket": pa.array(np.full(len(begin), table.column("bucket")[0].as_py()), pa.int32()),
            "askers": pa.ListArray.from_arrays(cuts, pa.array(asker[order], pa.int64())),
            "bodies": pa.ListArray.from_arrays(cuts, bodies.flatten().take(pa.array(order))),
        })

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("asker")
        askers = table.column("asker").to_numpy()
        replies = settle(askers, [x.as_buffer() for x in table.column("body")])
        return pa.table({
            "asker": pa.array(askers, pa.int64()),
            "part": pa.array(table.column("part").to_pylist(), pa.int32()),
            "answer": pa.array(replies, pa.binary()),
        })

    def answer_buckets(table: pa.Table) -> pa.Table:
        lists = table.column("askers").combine_chunks()
        sizes, part = np.asarray(lists.value_lengths()), table.column("part")[0].as_py()
        asked = pa.table({
            "part": pa.array(np.full(int(sizes.sum()), part), pa.int32()), "asker": lists.flatten(),
            "place": pa.array(np.arange(int(sizes.sum()))), "body": table.column("bodies").combine_chunks().flatten(),
        }).sort_by("asker")
        replies = settle(asked.column("asker").to_numpy(), [x.as_buffer() for x in asked.column("body")])
        back = np.argsort(asked.column("place").to_numpy())
        cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.table({
            "route": pa.array(np.full(len(table), part // subs), pa.int32()), "bucket": table.column("bucket"),
            "part": table.column("part"), "askers": lists,
            "replies": pa.ListArray.from_arrays(cuts, pa.array(replies, pa.binary()).take(pa.array(back))),
        })

    def scatter(table: pa.Table) -> pa.Table:
        """A bucket's answers by asker."""
        table = table.combine_chunks()
        askers, told = table.column("askers").combine_chunks(), table.column("replies").combine_chunks()
        asker = askers.flatten().to_numpy()
        part = np.repeat(table.column("part").to_numpy(), np.asarray(askers.value_lengths()))
        order = np.lexsort((part, asker))
        begin = np.flatnonzero(np.append(True, asker[order][1:] != asker[order][:-1]))
        entries = pa.StructArray.from_arrays([pa.array(part[order], pa.int32()), told.flatten().take(pa.array(order))], ["part", "answer"])
        return pa.table({
            "asker": pa.array(asker[order][begin]),
            "answers": pa.ListArray.from_arrays(pa.array(np.append(begin, len(asker)), pa.int32()), entries),
        })

    asking = blocks.select("block", "payload", *known)
    if direct:
        answered = groups_in_arrow(in_arrow(asking, ask, "part int, asker long, body binary"), ["part"], answer, "asker long, part int, answer binary")
        replies = answered.groupBy("asker").agg(F.collect_list(F.struct("part", "answer")).alias("answers"))
    else:
        routed = in_arrow(asking, ask_routes, "route int, asker long, parts array<int>, bodies array<binary>")
        routed = routed.withColumn("bucket", F.pmod(F.xxhash64("asker"), F.lit(buckets)).cast("int"))
        gathered = groups_in_arrow(routed, ["route", "bucket"], gather, "part int, bucket int, askers array<long>, bodies array<binary>")
        answered = groups_in_arrow(gathered, ["part"], answer_buckets, "route int, bucket int, part int, askers array<long>, replies array<binary>")
        scattered = groups_in_arrow(answered, ["route", "bucket"], scatter, "asker long, answers array<struct<part:int,answer:binary>>")
        replies = scattered.groupBy("asker").agg(F.flatten(F.collect_list("answers")).alias("answers"))
    if keep:
        replies = stored(replies)
    return blocks.join(replies, F.col("block") == F.col("asker"), "left").select("block", "payload", *known, "answers")


def parts_for(blocks: DataFrame, bytes_each: int = 16 << 20, share: float = 1.0) -> int:
    """How many parts to deal ``share`` times the text's bytes into; at least the shuffle partitions."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(partitions(blocks), int(total * share // bytes_each) + 1)
