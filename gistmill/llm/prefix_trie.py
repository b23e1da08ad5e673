"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Its path hash is the exclusive or of hashes of
(place, turn), so that prefixes of a conversation of any length are hashed by running sums in pieces. Nodes
are grouped rows; a node is named by its smallest member and its depth.

Nodes of one smallest member and one number of members are a chain: only the lowest may have several children
or members that end. Chains (cut at every ``BAND`` levels) are the units of the totals. They are dealt into shards, each a whole
subtree of at most ``bounds[0]`` members, sorted externally by Spark in reverse level order, and read
once: a chain takes what its children have sent from a priority queue, adds its own, and sends the sum
forward to its parent. What leaves a shard is summed by target and enters the next tier, of larger subtrees, and
at last the top, where only chains of more than ``bounds[-1]`` members are left.
"""

import heapq
import itertools
import tempfile
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.llm import tables
from gistmill.operators import lookup
from gistmill.operators.ordering import rank_rows

BAND = 4096
WORDS = r"[^\x20\x09-\x0D]+"
_SEGMENT = 1 << 13


class SpillingQueue:
    """A priority queue of equal-length tuples of integers that keeps at most ``most`` in memory.

    Beyond that all are sorted and written to an unnamed file of the task, which is gone with the task; such runs are
    read back a block at a time and merged.
    """

    def __init__(self, most: int = 1 << 18):
        self.most, self.heap, self.runs = most, [], []

    def push(self, item: tuple[int, ...]) -> None:
        if len(self.heap) >= self.most:
            self._spill()
        heapq.heappush(self.heap, item)

    def head(self) -> tuple[int, ...] | None:
        heads = [self.heap[0]] if self.heap else []
        heads += [run[1] for run in self.runs]
        return min(heads, default=None)

    def pop(self) -> tuple[int, ...]:
        item = self.head()
        if self.heap and self.heap[0] == item:
            return heapq.heappop(self.heap)
        run = next(x for x in self.runs if x[1] == item)
        run[1] = next(run[0], None)
        if run[1] is None:
            self.runs.remove(run)
        return item

    def _spill(self) -> None:
        from pyspark.serializers import BatchedSerializer, CPickleSerializer

        file, codec = tempfile.TemporaryFile(), BatchedSerializer(CPickleSerializer(), 1024)
        codec.dump_stream(iter(sorted(self.heap)), file)
        file.seek(0)
        self.heap = []
        items = codec.load_stream(file)
        self.runs.append([items, next(items)])


def _digested(turns: DataFrame, place: str) -> DataFrame:
    """(conv_id, place, h1, h2, words): role and text of a turn as two hashes and a number of words. Texts go no further."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), place, F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    ).filter("conv_id IS NOT NULL")


def prefix_sharing(convs: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Rebuilt conversations, with ``depth`` (from 1) for ``position``: another's first turns, then one's own.

    ``convs`` has ``conv_id``, ``position`` (from 1) and any other columns. With h = crc32 of the decimal id, modulo ``heads``, conversation
    c gets the first h turns of conversation c - c % ``group`` and its own after its first h.
    """
    rest = [c for c in convs.columns if c not in ("conv_id", "position")]
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    own = convs.withColumn("_h", h).filter("position > _h")
    # at most heads - 1 turns of a base, once for each of the ids that may have it
    base = F.col("conv_id") - F.col("conv_id") % group
    known = convs.select("conv_id").distinct().select("conv_id", base.alias("_base"), h.alias("_h"))
    first = convs.filter(F.col("position") < heads).withColumnRenamed("conv_id", "_base")
    lent = known.filter("_h > 0").join(first, "_base").filter("position <= _h")
    sizes = lent.groupBy("conv_id").agg(F.count("*").alias("_lent"))
    depth = F.col("position") - F.col("_h") + F.coalesce("_lent", F.lit(0))
    placed = own.join(sizes, "conv_id", "left").select("conv_id", depth.alias("depth"), *rest)
    return lent.select("conv_id", F.col("position").cast("long").alias("depth"), *rest).unionByName(placed)


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, y1, y2, words): hashes of the path to a turn and of the path to the turn before.

    Running exclusive ors within bands of depth, lifted by those of earlier bands: no conversation is one task's.
    """
    hashed = turns.select(
        "conv_id", "depth", "words", F.expr(f"(depth - 1) div {BAND}").alias("band"),
        F.xxhash64("depth", "h1", "h2").alias("t1"), F.xxhash64("h2", "h1", "depth").alias("t2"),
    )
    inside = Window.partitionBy("conv_id", "band").orderBy("depth")
    running = hashed.select("*", F.bit_xor("t1").over(inside).alias("r1"), F.bit_xor("t2").over(inside).alias("r2"))
    bands = hashed.groupBy("conv_id", "band").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    lifts = bands.select("conv_id", "band", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("b1", "b2")])
    lifted = running.join(lifts, ["conv_id", "band"])
    x1, x2 = F.col("r1").bitwiseXOR(F.col("b1")), F.col("r2").bitwiseXOR(F.col("b2"))
    y1, y2 = x1.bitwiseXOR(F.col("t1")), x2.bitwiseXOR(F.col("t2"))
    return lifted.select("conv_id", "depth", x1.alias("x1"), x2.alias("x2"), y1.alias("y1"), y2.alias("y2"), "words")


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, x1, x2, digest)``: SHA-256 of the ids that end at a node, ascending, joined by commas.

    Ids are sorted in range partitions, which join them to texts of some 8,192; a node's texts, in order, go through
    one running digest, as SHA-256 needs.
    """
    keys, kinds = ["depth", "x1", "x2"], "depth long, x1 long, x2 long"
    ranged = ends.repartitionByRange(tables.partitions(ends), *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")

    def rows_of(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in (*keys, "conv_id", *more)])

    def batched(rows: Iterator[tuple], names: list[str], most: int) -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(rows, most):
            columns = [pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in zip(*some)]
            yield pa.RecordBatch.from_arrays(columns, names)

    def segments(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, own in groupby(rows, itemgetter(0, 1, 2)):
            for some in itertools.batched((row[3] for row in own), _SEGMENT):
                yield *key, some[0], ",".join(map(str, some))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(segments(rows_of(batches)), [*keys, "conv_id", "ids"], 64)

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, own in groupby(rows, itemgetter(0, 1, 2)):
            running, lead = sha256(), ""
            for row in own:
                running.update((lead + row[4]).encode())
                lead = ","
            yield *key, running.hexdigest()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(digests(rows_of(batches, "ids")), [*keys, "digest"], 4096)

    texts = tables.in_arrow(ranged, join, f"{kinds}, conv_id long, ids string")
    ordered = texts.repartition(tables.partitions(ends), *keys).sortWithinPartitions(*keys, "conv_id")
    return tables.in_arrow(ordered, digest, f"{kinds}, digest string")


_RESULT = "conv_id long, n_convs long, band long, to_conv long, to_n long, to_band long, leaves long, saved long"
_CHAIN = ["conv_id", "n_convs", "band"]


def _forward(chains: DataFrame, shard: Sequence[str], queue: int) -> DataFrame:
    """Time-forward pass over chains (conv_id, n_convs, band, low, high, to_conv, to_n, childless, own, leaves, saved).

    ``leaves`` and ``saved`` are what came from outside. Rows of a chain give what its children sent; rows of a target (to_...)
    are sums for chains that aren't here.
    """
    parts = tables.partitions(chains)
    dealt = chains.repartition(parts, *shard) if shard else chains.repartition(1)
    # reverse level order: deepest first; a parent's lowest level is the one above its child's highest
    ordered = dealt.sortWithinPartitions(*shard, F.desc("high"), "conv_id", "n_convs")
    names = [*shard, "conv_id", "n_convs", "band", "low", "high", "to_conv", "to_n", "childless", "own", "leaves", "saved"]

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, out, group = SpillingQueue(queue), [], None

        def leave(until: tuple[int, ...] | None) -> None:
            """What is addressed to a chain before ``until`` in the order has no such chain here."""
            while (item := waiting.head()) is not None and (until is None or item[:3] < until):
                waiting.pop()
                out.append((None, None, None, item[1], item[2], -item[0] // BAND, item[3], item[4]))

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names]):
                own_shard, row = row[:len(shard)], row[len(shard):]
                conv, n, band, low, high, to_conv, to_n, childless, own, leaves, saved = row
                if own_shard != group:
                    leave(None)
                    group = own_shard
                key = (-high, conv, n)
                leave(key)
                while (item := waiting.head()) is not None and item[:3] == key:
                    waiting.pop()
                    leaves, saved = leaves + item[3], saved + item[4]
                if childless:
                    leaves = 1
                out.append((conv, n, band, None, None, None, leaves, saved))
                if to_conv is not None:
                    waiting.push((-(low - 1), to_conv, to_n, leaves, saved + own))
                if len(out) >= 8192:
                    yield records(out)
                    out.clear()
        leave(None)
        yield records(out)

    def records(rows: list[tuple]) -> pa.RecordBatch:
        fields = [x.split()[0] for x in _RESULT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(fields))], fields)

    return tables.in_arrow(ordered.select(names), process, _RESULT)


def _lookup(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the values that a table unique on ``key`` has for theirs; the table is broadcast only if measured small."""
    values = [c for c in table.columns if c != "key"]
    if lookup.fits_broadcast(table, F.lit(16 + 8 * len(values))):
        return lookup.broadcast_lookup(rows, table, "key")
    return lookup.frequent_lookup(rows, table, "key")


def prefix_trie(
    turns: DataFrame, members: DataFrame, bounds: Sequence[int] = (1_000, 1_000_000), queue: int = 1 << 18
) -> DataFrame:
    """The trie of the conversations ``members`` (conv_id), whose turns are ``(conv_id, depth, role, text)``, depth from 1 without gaps.

    A row for each distinct sequence of first turns, the empty one among them: ``conv_id`` (its smallest member),
    ``depth``, ``parent_conv_id`` (root: null), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes
    in its subtree, itself included), ``saved_tokens`` ((n_convs - 1) times the words of the last text, summed over the
    subtree) and ``ends_sha256`` (of the ascending decimal ids of members that end there, joined by commas).

    ``bounds``: a shard of tier k is a subtree of at most ``bounds[k]`` members. The last step, in one task, reads chains of more than
    ``bounds[-1]`` members: fewer than one for each that many rows. Sums need no order of rows, so results do not depend on either
    parameter. Two paths share a hash of 128 bits by chance about once in 10^38 pairs.

    Null role or text counts as empty. Members without turns end at the root. Null ids take no part. Repeated members count once.
    Turns of an id that isn't a member must not occur. Other columns don't matter. No members, no rows.
    """
    return _trie(_digested(turns, "depth"), members.select(F.col("conv_id").cast("long").alias("conv_id")), bounds, queue)


def _trie(turns: DataFrame, members: DataFrame, bounds: Sequence[int], queue: int) -> DataFrame:
    members = members.filter("conv_id IS NOT NULL").distinct()
    turns = turns.withColumn("depth", F.col("depth").cast("long"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("x1", "x2", "y1", "y2", "words")]
    rows = tables.stored(_paths(turns).unionByName(members.select("conv_id", F.lit(0).cast("long").alias("depth"), *zero)))
    nodes = tables.stored(
        rows.groupBy("depth", "x1", "x2").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("y1").alias("y1"), F.max("y2").alias("y2"),
        ).withColumn("band", F.expr(f"depth div {BAND}")),
        narrow=True,
    )
    path = lambda depth, a, b: F.struct(depth.alias("depth"), F.col(a).alias("a"), F.col(b).alias("b")).alias("key")
    own_key, parent_key = path(F.col("depth"), "x1", "x2"), path(F.col("depth") - 1, "y1", "y2")
    children = nodes.filter("depth > 0").groupBy(parent_key).agg(F.count("*").alias("n_children"))
    nodes = tables.stored(
        nodes.withColumn("key", own_key).join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("key"),
        narrow=True,
    )
    # chains; only their highest node needs to know its parent
    top = F.min(F.struct("depth", "y1", "y2"))
    chains = nodes.groupBy(*_CHAIN).agg(
        top.alias("top"), F.max("depth").alias("high"), (F.sum("words") * (F.col("n_convs") - 1)).alias("own"),
        F.min("n_children").alias("fewest"),
    ).select(*_CHAIN, F.col("top.depth").alias("low"), "high", "own", (F.col("fewest") == 0).alias("childless"), F.col("top.y1").alias("y1"), F.col("top.y2").alias("y2"))
    tops = nodes.filter("n_children > 0").select(own_key, F.col("conv_id").alias("to_conv"), F.col("n_convs").alias("to_n"))
    asking = chains.withColumn("key", F.when(F.col("low") > 0, path(F.col("low") - 1, "y1", "y2")))
    chains = tables.stored(_lookup(asking, tops).drop("key", "y1", "y2"), narrow=True)
    totals = _totals(rows, nodes, chains, bounds, queue)
    # within a chain the levels below are summed by a window of at most BAND rows
    below = Window.partitionBy(*_CHAIN).orderBy(F.desc("depth"))
    saved = F.col("saved") + F.sum(F.col("words") * (F.col("n_convs") - 1)).over(below)
    up = chains.select(*_CHAIN, "low", "to_conv")
    named = nodes.join(totals, _CHAIN).join(up, _CHAIN).withColumn("saved_tokens", saved)
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "x1", "x2")).alias("end")).select("conv_id", "end.*")
    digests = _end_digests(tables.stored(last, narrow=True))
    parent = F.when(F.col("depth") == F.col("low"), F.col("to_conv")).otherwise(F.col("conv_id"))
    return named.join(digests, ["depth", "x1", "x2"], "left").select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens",
        F.coalesce("digest", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )


def _totals(rows: DataFrame, nodes: DataFrame, chains: DataFrame, bounds: Sequence[int], queue: int) -> DataFrame:
    """(conv_id, n_convs, band, leaves, saved) of all chains: what their children's subtrees have, tier by tier."""
    key = F.struct("depth", F.col("x1").alias("a"), F.col("x2").alias("b")).alias("key")
    # a conversation's shard in a tier is the first node on its path that has few enough members
    large = nodes.filter(F.col("n_convs") > bounds[0]).select(key, F.col("n_convs").alias("members"))
    on_path = _lookup(rows.select("conv_id", "depth", "x1", "x2", key), large)
    firsts = [
        F.min(F.when(F.coalesce("members", F.lit(0)) <= bound, F.struct("depth", "x1", "x2"))).alias(f"shard{tier}") for tier, bound in enumerate(bounds)
    ]
    shards = on_path.groupBy("conv_id").agg(*firsts)
    dealt = tables.stored(chains.join(shards, "conv_id"), narrow=True)
    sent, totals = None, []
    lowest = 0
    for tier, bound in enumerate([*bounds, None]):
        here = dealt.filter(F.col("n_convs") > lowest)
        if bound is not None:
            here = here.filter(F.col("n_convs") <= bound)
        if sent is None:
            here = here.withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            here = here.join(sent, _CHAIN, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("leaves", "saved")})
        shard: list[str] = []
        if bound is not None:
            here = here.select("*", *[F.col(f"shard{tier}.{c}").alias(f"s{c}") for c in ("depth", "x1", "x2")])
            shard = ["sdepth", "sx1", "sx2"]
        found = tables.stored(_forward(here, shard, queue), narrow=True)
        totals.append(found.filter("conv_id IS NOT NULL").select(*_CHAIN, "leaves", "saved"))
        out = found.filter("conv_id IS NULL").select(
            F.col("to_conv").alias("conv_id"), F.col("to_n").alias("n_convs"), F.col("to_band").alias("band"), "leaves", "saved"
        )
        sent = out if sent is None else sent.filter(F.col("n_convs") > (bound or 0)).unionByName(out)
        sent = sent.groupBy(*_CHAIN).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        lowest = bound
    result = totals[0]
    for more in totals[1:]:
        result = result.unionByName(more)
    return result


def conversation_trie(
    conversations: DataFrame, group: int = 20, heads: int = 4, bounds: Sequence[int] = (1_000, 1_000_000), queue: int = 1 << 18
) -> DataFrame:
    """:func:`prefix_trie` of conversations rebuilt by :func:`prefix_sharing` from rows (conv_id, turn, role, text).

    Turns are ordered by ``turn``, null first; those of equal ``turn`` by a fixed hash of role and text. Rows with a null id take no part.
    Remainders of negative ids are those of SQL (-5 % 20 = -5).
    """
    order: list[Column] = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    numbered = tables.stored(rank_rows(_digested(conversations, "turn"), order, by=["conv_id"]).drop("turn"))
    return _trie(prefix_sharing(numbered, group, heads), numbered.select("conv_id"), bounds, queue)
