"""Jaccard join on word n-grams by rare-first prefix filtering.

All shingles are ordered by the number of documents that have them, rarest first, ties by hash. Two sets of a
Jaccard similarity of t or more share one of the first n - ceil(t * n) + 1 shingles of each, so that only these prefixes
are joined, and of them only shingles that another document has. What meets on a shingle is held against three
filters: lengths; places of the shingle in both orders, which bound what may follow; and the suffixes after it, by
numbers of shingles in 32 ranges of hashes. What passes is verified on full sets, once a pair.

Components need no more links than connect them. Each prefix shingle's smallest class is joined to the others
first; then only classes that share a prefix shingle and aren't connected yet are compared, in pairs of chunks of
bounded size, so that however many share a shingle, pairs of them never become rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm import tables
from gistmill.llm.near_dedup import NO_ID, components, shingle_sets
from gistmill.llm.value_totals import totals_of, with_totals
from gistmill.llm.words import mix, slices

RANGES = 32
#: Documents of a side of a cell, and shingles of a chunk.
CELL, CHUNK = 1024, 1 << 17


def _prints(values: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    totals = (np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(salt)))]) for salt in (1, 2))
    return [(total[cuts[1:]] - total[cuts[:-1]]).view(np.int64) for total in totals]


def _keys(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct shingles, and how many of its different sets have each."""
    first = np.zeros(len(cuts) - 1, bool)
    first[np.unique(np.stack([*_prints(values, cuts), np.diff(cuts)]), axis=1, return_index=True)[1]] = True
    return np.unique(values[np.repeat(first, np.diff(cuts))], return_counts=True)


def _facts(docs: DataFrame, width: int, part: int, whole: int, plan: tuple[int, int, int] | None) -> DataFrame:
    """id, n, p1, p2 of each document; with a prefix that others share also alone, prefix, ranges, shingles.

    ``alone`` shingles come first in the order and occur in no other set; ``prefix`` has those after them up to the prefix's end,
    in order; ``ranges`` and ``shingles`` are of all that others may have.
    """
    blocks = tables.packed_blocks(docs, "id", "text")

    def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _keys(*shingle_sets(batch.column("text"), width))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for payload, answers in zip(rows.column("payload"), rows.column("answers")):
                batch, totals = tables.unpack(payload.as_buffer()), totals_of(answers.as_py())
                values, cuts = shingle_sets(batch.column("text"), width)
                n = np.diff(cuts)
                owner = np.repeat(np.arange(len(n)), n)
                count = totals[np.unique(values, return_inverse=True)[1].ravel()] if len(values) else np.zeros(0, np.uint8)
                order = np.lexsort((values, count, owner))
                shared = count > 1
                alone = n - np.bincount(owner, weights=shared, minlength=len(n)).astype(np.int64)
                end = n + (-part * n // whole) + 1
                ranges = np.bincount((owner * RANGES + (values >> np.uint64(59)).astype(np.int64))[shared], minlength=len(n) * RANGES)
                ranges = ranges.reshape(-1, RANGES).astype("<u4")
                kept = values[shared]
                begin = np.concatenate([[0], np.cumsum(n - alone)])
                prefix = np.full(len(n), None, object)
                bodies, shingles = prefix.copy(), prefix.copy()
                for d in np.flatnonzero(alone < end).tolist():
                    if n[d]:
                        prefix[d] = values[order[cuts[d] + alone[d]:cuts[d] + end[d]]].tobytes()
                        bodies[d] = ranges[d].tobytes()
                        shingles[d] = kept[begin[d]:begin[d + 1]].tobytes()
                p1, p2 = _prints(values, cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *[pa.array(x, pa.int64()) for x in (n, p1, p2, alone)], *[pa.array(x, pa.binary()) for x in (prefix, bodies, shingles)]],
                    ["id", "n", "p1", "p2", "alone", "prefix", "ranges", "shingles"],
                )

    asked = with_totals(blocks, keys_of, share=0.5, plan=plan).select("payload", "answers")
    return tables.in_arrow(asked, finish, "id long, n long, p1 long, p2 long, alone long, prefix binary, ranges binary, shingles binary")


def _postings(sets: DataFrame) -> DataFrame:
    """(token, cls, n, place): a row for each prefix shingle that others may have."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "prefix"):
            bodies = batch.column("prefix").to_pylist()
            counts = np.array([len(x) // 8 for x in bodies], np.int64)
            begin = np.cumsum(counts) - counts
            place = np.arange(int(counts.sum())) + np.repeat(np.asarray(batch.column("alone")) - begin, counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(b"".join(bodies), np.int64)),
                *[pa.array(np.repeat(np.asarray(batch.column(c)), counts)) for c in ("cls", "n")], pa.array(place),
            ], ["token", "cls", "n", "place"])

    return tables.in_arrow(sets.select("cls", "n", "alone", "prefix"), post, "token long, cls long, n long, place long")


def _similar(both: Column, m: Column, n: Column, part: int, whole: int) -> Column:
    return both * whole >= (m + n - both) * part


def _verified(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs (a, b) that are similar on their full sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = np.asarray(batch.column("m")), np.asarray(batch.column("n"))
            both = np.zeros(len(m), np.int64)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both[k] = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()
            yield batch.select(["a", "b"]).filter(pa.array(both * whole >= (m + n - both) * part))

    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("m"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), "n", F.col("shingles").alias("y"))
    return tables.in_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y"), verify, "a long, b long")


def _chunks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, component, chunk): classes in chunks of about ``CHUNK`` shingles, one larger class alone or with few others.

    Small components whose prefixes meet in one class share chunks; a large one has chunks of its own.
    """
    home = members.groupBy("cls").agg(F.min("center.cls").alias("home"), F.max("n").alias("n"))
    named = home.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "home", "n", F.coalesce("component", "cls").alias("component"))
    named = tables.stored(named, narrow=True)
    sizes = named.groupBy("home", "component").agg(F.sum("n").alias("size"))
    small = sizes.filter(F.col("size") < CHUNK).groupBy("home").agg(F.sum("size").alias("small"))
    large = F.col("size") >= CHUNK
    pieces = F.ceil(F.when(large, F.col("size")).otherwise(F.col("small")) / CHUNK)
    spot = F.pmod(F.when(large, F.xxhash64("cls")).otherwise(F.xxhash64("component")), pieces)
    return named.join(sizes.join(small, "home", "left"), ["home", "component"]).select(
        "cls", "component", F.xxhash64("home", F.when(large, F.col("component")), spot).alias("chunk")
    )


def _suffixes(prefix: list[bytes], ranges: list[bytes], alone: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each row how many of the shingles after its place in the order fall into each range of hashes."""
    out = np.frombuffer(b"".join(ranges), "<u4").reshape(-1, RANGES).astype(np.int64)
    for k, body in enumerate(prefix):
        before = np.frombuffer(body, np.uint64)[:place[k] - alone[k] + 1]
        out[k] -= np.bincount((before >> np.uint64(59)).astype(np.int64), minlength=RANGES)
    return out


def _chunk_pairs(members: DataFrame, chunks: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs of chunks (low, high) that hold two unconnected classes which a prefix shingle joins and no filter parts.

    All of a shingle's classes but those of its largest component are held against all, in cells of about 1,024 by 1,024.
    """
    named = tables.stored(members.join(chunks, "cls").select("token", "cls", "n", "place", "component", "chunk"), narrow=True)
    sizes = named.groupBy("token", "component").agg(F.count("*").alias("size"))
    mixed = tables.stored(
        sizes.groupBy("token").agg(F.count("*").alias("kinds"), F.sum("size").alias("size"), F.max(F.struct("size", "component")).alias("largest"))
        .filter("kinds > 1")
        .select(
            "token", F.col("largest.component").alias("largest"),
            F.ceil((F.col("size") - F.col("largest.size")) / CELL).cast("int").alias("rows"), F.ceil(F.col("size") / CELL).cast("int").alias("columns"),
        ),
        narrow=True,
    )
    placed = named.join(mixed, "token").withColumn("main", F.col("component") == F.col("largest"))
    spot = F.xxhash64("cls")
    left = placed.filter("NOT main").withColumn("is_row", F.lit(True)).withColumn("row", F.pmod(spot, "rows").cast("int"))
    left = left.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    right = placed.withColumn("is_row", F.lit(False)).withColumn("column", F.pmod(spot, "columns").cast("int"))
    right = right.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    names = ["token", "row", "column", "is_row", "cls", "n", "place", "component", "chunk", "main"]
    cells = tables.stored(left.select(names).unionByName(right.select(names)), narrow=True)
    parts = max(tables.partitions(members), cells.count() // 16384 + 1)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("token", "row", "column")])
        cell = np.stack([table.column(c).to_numpy() for c in ("token", "row", "column")])
        begin = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)]))
        is_row, main, cls, n, place, component, chunk, alone = (
            table.column(c).to_numpy() for c in ("is_row", "main", "cls", "n", "place", "component", "chunk", "alone")
        )
        suffix = _suffixes(table.column("prefix").to_pylist(), table.column("ranges").to_pylist(), alone, place)
        found = set()
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(cls)]):
            right = a + np.flatnonzero(~is_row[a:b])
            for i in (a + np.flatnonzero(is_row[a:b])).tolist():
                # of two outside the largest component, the smaller looks for the larger
                j = right[(component[right] != component[i]) & (main[right] | (cls[right] > cls[i]))]
                j = j[np.minimum(n[i], n[j]) * whole >= np.maximum(n[i], n[j]) * part]
                most = np.minimum(n[i] - place[i], n[j] - place[j])
                j = j[most * whole >= (n[i] + n[j] - most) * part]
                most = 1 + np.minimum(suffix[j], suffix[i]).sum(axis=1)
                j = j[most * whole >= (n[i] + n[j] - most) * part]
                found.update((min(chunk[i], x), max(chunk[i], x)) for x in set(chunk[j].tolist()))
        pairs = sorted(found)
        return pa.table({"low": pa.array([x for x, _ in pairs], pa.int64()), "high": pa.array([x for _, x in pairs], pa.int64())})

    dealt = cells.join(sets.select("cls", "alone", "prefix", "ranges"), "cls")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("token", "row", "column"), F.lit(parts)).cast("int"))
    return tables.groups_in_arrow(dealt, ["part"], compare, "low long, high long").distinct()


def _linked_across(pairs: DataFrame, chunks: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Verified links (a, b) between components of pairs of chunks; what a link connects isn't compared further."""
    sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("chunk"))
    rows = sides.join(chunks, "chunk").join(sets.select("cls", "n", "alone", "shingles"), "cls")

    def verify(table: pa.Table) -> pa.Table:
        chunk, cls, component, n, alone = (table.column(c).to_numpy() for c in ("chunk", "cls", "component", "n", "alone"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        root = {x: x for x in component.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for i in left.tolist():
            j = right[component[right] != component[i]]
            j = j[cls[j] > cls[i]] if low == high else j
            most = np.minimum(n[i] - alone[i], n[j] - alone[j])
            j = j[most * whole >= (n[i] + n[j] - most) * part]
            j = np.array([x for x in j.tolist() if find(int(component[x])) != find(int(component[i]))], np.int64)
            if not len(j):
                continue
            held, sizes = np.concatenate([sets[x] for x in j]), np.array([len(sets[x]) for x in j])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], held), len(sets[i]) - 1)] == held
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            for x in j[both * whole >= (n[i] + n[j] - both) * part].tolist():
                a, b = find(int(component[i])), find(int(component[x]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((cls[i], cls[x]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return tables.groups_in_arrow(rows, ["low", "high"], verify, "a long, b long")


def jaccard_join(
    docs: DataFrame, width: int = 3, part: int = 90, whole: int = 100, id_column: str = "doc_id", text_column: str = "text",
    plan: tuple[int, int, int] | None = None,
) -> DataFrame:
    """For each row of ``docs``: its id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Two documents are linked where ``whole`` * intersection >= ``part`` * union of their sets of ``width``-word shingles (A-Z
    lower-cased; fewer words: the whole sequence is one shingle). Shingles are compared by 64 bits, equal sets by 128.
    ``plan``: see :func:`value_totals.with_totals`; results don't depend on it.

    Null or empty text: no shingles, linked with nothing, its own component. Rows of equal id are one document, linked with all that any of
    them is linked with. Null ids count as one id larger than all others and come back as null. Other columns don't matter. No rows in, no rows out.
    """
    plain = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_column).alias("text"))
    facts = tables.stored(_facts(plain, width, part, whole, plan))
    prints = ["p1", "p2", "n"]
    classes = facts.filter("n > 0").groupBy(*prints).agg(F.min("id").alias("rep")).withColumn("cls", F.monotonically_increasing_id())
    classes = tables.stored(classes, narrow=True)
    sets = tables.stored(
        facts.filter("prefix IS NOT NULL").join(classes, prints).filter("id = rep").drop("id", "rep", "p1", "p2").dropDuplicates(["cls"])
    )
    postings = _postings(sets)
    lists = postings.groupBy("token").agg(F.count("*").alias("size"), F.min(F.struct("cls", "n", "place")).alias("center"))
    members = tables.stored(postings.join(lists.filter("size > 1").drop("size"), "token"), narrow=True)
    n, m = F.col("n"), F.col("center.n")
    most = F.least(n - F.col("place"), m - F.col("center.place"))
    star = members.filter("cls <> center.cls").filter(F.least(m, n) * whole >= F.greatest(m, n) * part).filter(_similar(most, m, n, part, whole))
    first = _verified(star.select(F.col("center.cls").alias("a"), F.col("cls").alias("b")).distinct(), sets, part, whole)
    # rows of one id are one document, whatever their texts
    owned = facts.filter("n > 0").join(classes, prints).select("id", "cls").distinct()
    several = owned.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a < z").select("id", "a")
    same = owned.join(several, "id").filter("cls > a").select("a", F.col("cls").alias("b"))
    labels = tables.stored(components(first.unionByName(same)), narrow=True)
    chunks = tables.stored(_chunks(members, labels), narrow=True)
    pairs = tables.stored(_chunk_pairs(members, chunks, sets, part, whole), narrow=True)
    more = tables.stored(_linked_across(pairs, chunks, sets, part, whole), narrow=True)
    if not more.isEmpty():
        labels = tables.stored(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), narrow=True)
    grouped = classes.join(labels, F.col("cls") == F.col("node"), "left").select(*prints, "rep", F.coalesce("component", "cls").alias("component"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("least"))
    named = facts.select("id", *prints).join(grouped.join(least, "component").select(*prints, "least"), prints, "left")
    known = lambda c: F.when(c != NO_ID, c)
    return named.select(
        known(F.col("id")).alias(id_column), F.col("n").alias("n_shingles"), known(F.coalesce("least", "id")).alias("component_id")
    )
