"""Near-duplicate groups: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation, components.

A signature has 64 positions of 16 bits, each the low bits of a minimum over the document's
shingles. It is split into 16 chunks of 4 positions. By the pigeonhole principle two
signatures that differ in at most 31 positions have a chunk with at most one wrong position;
enumerating the wrong one leaves 3 equal positions, so a document has 64 keys and every such
pair shares a key. At a similarity of 0.75 a pair differs in 16 positions on average and in more
than 31 once in about 100,000 pairs, and even those miss all keys only once in 10^9.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import tables
from gistmill.llm.words import LOWER, Words, joined_hash, mix, slices, text_bytes, window_hashes

POSITIONS, CHUNK = 64, 4
MOST_WRONG = 2 * (POSITIONS // CHUNK) - 1
NO_ID = (1 << 63) - 1
_RNG = np.random.Generator(np.random.PCG64(20))
_SALT = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CELL, _CHUNK_ROWS = 1024, 256


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after another, and where each text's begin and the last's end."""
    data, offsets = text_bytes(column)
    words = Words(LOWER[data], offsets)
    h, doc = words.hashes(), words.doc()
    usable = words.left_in_doc() >= width
    at = np.flatnonzero(usable)
    values, owner = window_hashes(h, width)[at], doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            x = mix(np.array([words.counts[d]], np.uint64))
            for y in h[words.first[d]:words.first[d + 1]]:
                x = joined_hash(x, np.array([y]))
            whole[k] = x[0]
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(words.counts) + 1))


def signatures(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One row of ``POSITIONS`` 16-bit minima for each non-empty set."""
    begin = cuts[:-1][np.diff(cuts) > 0]
    out = np.empty((len(begin), POSITIONS), np.uint16)
    for j in range(POSITIONS if len(begin) else 0):
        x = values ^ _SALT[j]
        x *= _ODD[j]
        out[:, j] = mix(np.minimum.reduceat(x, begin)) & np.uint64(0xFFFF)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """For each signature a key for each chunk and each position in it that may be wrong."""
    chunks = signature.reshape(len(signature), -1, CHUNK).astype(np.uint64)
    keys = []
    for wrong in range(CHUNK):
        x = np.zeros(chunks.shape[:2], np.uint64)
        for place in range(CHUNK):
            if place != wrong:
                x = (x << np.uint64(16)) | chunks[:, :, place]
        keys.append(mix(mix(x) + np.arange(chunks.shape[1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(wrong)))
    return np.concatenate(keys, axis=1)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """id, doc, n_shingles, two halves of the set's fingerprint, signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, cuts = shingle_sets(batch.column("text"), width)
            sizes = np.diff(cuts)
            full = sizes > 0
            prints = []
            for salt in (1, 2):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(salt)))])
                prints.append(pa.array((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64)))
            bodies = np.full(len(full), None, object)
            bodies[full] = [row.tobytes() for row in signatures(values, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("doc"), pa.array(sizes, pa.int64()), *prints, pa.array(bodies, pa.binary())],
                ["id", "doc", "n_shingles", "p1", "p2", "signature"],
            )

    return tables.in_arrow(docs, sign, "id long, doc long, n_shingles long, p1 long, p2 long, signature binary")


def _members(reps: DataFrame, parts: int) -> DataFrame:
    """Rows (key, center, rep) of all keys that several documents have.

    Every batch settles its own documents that share a key and sends only the smallest of
    them on, so a key of very many documents is met once from each batch.
    """
    schema = "part int, body binary, key long, center long, rep long"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column("rep").to_numpy()
            order = np.argsort(rep, kind="stable")
            rep = rep[order]
            joined = b"".join(batch.column("signature").take(pa.array(order)).to_pylist())
            keys = chunk_keys(np.frombuffer(joined, np.uint16).reshape(-1, POSITIONS))
            owner = np.repeat(rep, keys.shape[1])
            keys = keys.ravel()
            by = np.argsort(keys, kind="stable")
            keys, owner = keys[by], owner[by]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            yield _links(keys, owner, new, schema)
            keys, owner = keys[new], owner[new]
            order, cuts = tables.deal((keys % np.uint64(parts)).astype(np.int64), parts)
            keys, owner = keys[order], owner[order]
            sent = tables.dealt_bodies(lambda a, b: keys[a:b].tobytes() + owner[a:b].tobytes(), cuts)  # noqa: B023
            yield _rows(schema, part=[p for p, _ in sent], body=[x for _, x in sent])

    def meet(table: pa.Table) -> pa.Table:
        keys, owner = [], []
        for body in table.column("body"):
            both = np.frombuffer(body.as_buffer(), np.uint64)
            keys.append(both[:len(both) // 2])
            owner.append(both[len(both) // 2:].view(np.int64))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        by = np.lexsort((owner, keys))
        keys, owner = keys[by], owner[by]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return pa.Table.from_batches([_links(keys, owner, new, schema)]).select(["key", "center", "rep"])

    out = tables.stored(tables.in_arrow(reps.select("rep", "signature"), emit, schema))
    local = out.filter(F.col("part").isNull()).select("key", "center", "rep")
    met = tables.groups_in_arrow(
        out.filter(F.col("part").isNotNull()).select("part", "body"), ["part"], meet, "key long, center long, rep long"
    )
    return local.unionByName(met)


def _rows(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    count = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(count, kinds[kind]) for name, kind in fields],
        [name for name, _ in fields],
    )


def _links(keys: np.ndarray, owner: np.ndarray, new: np.ndarray, schema: str) -> pa.RecordBatch:
    """A row for each document that isn't the first of its key."""
    center = owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(owner) else owner
    chosen = ~new & (center != owner)
    return _rows(schema, key=keys[chosen].view(np.int64), center=center[chosen], rep=owner[chosen])


def _close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most ``MOST_WRONG`` positions."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, POSITIONS) for x in ("s", "t"))
            yield batch.select(["a", "b"]).filter(pa.array((s != t).sum(axis=1) <= MOST_WRONG))

    left = reps.select(F.col("rep").alias("a"), F.col("signature").alias("s"))
    right = reps.select(F.col("rep").alias("b"), F.col("signature").alias("t"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t")
    return tables.in_arrow(both, near, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs with ``whole`` * intersection >= ``part`` * union on their full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[place] == y).sum())
                linked.append(whole * both >= part * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    # sizes alone rule a pair out if even full inclusion is too little
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("m"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("n"), F.col("shingles").alias("y"))
    fits = F.least("m", "n") * whole >= F.greatest("m", "n") * part
    both = pairs.join(left, "a").join(right, "b").filter(fits).select("a", "b", "x", "y")
    return tables.in_arrow(both, confirm, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of edges (a, b): the smallest node that can be reached.

    Large-star and small-star steps in turn, each written, until nothing changes. Neighbours are
    never gathered: each step joins a node's smallest neighbour to its edges.
    """
    edges = tables.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), narrow=True)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = tables.stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), narrow=True)
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, small)]
        edges = small
        if sums[0] == sums[1]:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _shared_counts(docs: DataFrame, width: int) -> DataFrame:
    """rep, n, c, shingles of documents: c shingles also occur in another of them, at least.

    Shingles are dealt by hash and asked about once by each block of documents. 32 bits within
    a part are enough: a chance match only makes c larger.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, cuts = shingle_sets(batch.column("text"), width)
            body = [values[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(cuts), pa.int64()), pa.array(body, pa.binary())], ["rep", "n", "shingles"])
            yield out.filter(pa.array(np.diff(cuts) > 0))

    blocks = tables.packed_blocks(docs, "rep", "shingles", prepare=gather)
    count = tables.parts_for(blocks, 4 << 20, share=0.5)

    def dealt(batch: pa.RecordBatch):
        flat = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)
        values, of, times = np.unique(flat, return_inverse=True, return_counts=True)
        order, cuts = tables.deal((values >> np.uint64(40)).astype(np.int64) % count, count)
        return values, of.ravel(), times, order, cuts

    def emit(batch: pa.RecordBatch) -> list[tuple[int, bytes]]:
        values, _, _, order, cuts = dealt(batch)
        short = values[order].astype("<u4")
        return tables.dealt_bodies(lambda a, b: short[a:b].tobytes(), cuts)

    def settle(askers: np.ndarray, bodies: list[bytes]) -> list[bytes]:
        parts = [np.frombuffer(body, "<u4") for body in bodies]
        _, of, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = times[of.ravel()] > 1
        return [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum([len(x) for x in parts])[:-1])]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for payload, answers in zip(rows.column("payload"), rows.column("answers")):
                batch = tables.unpack(payload.as_buffer())
                values, of, times, order, cuts = dealt(batch)
                shared = times > 1
                for entry in answers.as_py() or []:
                    a, b = cuts[entry["part"]], cuts[entry["part"] + 1]
                    shared[order[a:b]] |= np.unpackbits(np.frombuffer(entry["answer"], np.uint8), count=b - a).astype(bool)
                n = batch.column("n").to_numpy()
                c = np.add.reduceat(shared[of].astype(np.int64), np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep"), batch.column("n"), pa.array(c, pa.int64()), batch.column("shingles")], ["rep", "n", "c", "shingles"]
                )

    return tables.in_arrow(tables.exchange_blocks(blocks, count, emit, settle), finish, "rep long, n long, c long, shingles binary")


def _possible(m, c, n, d, part: int, whole: int):
    """Whether sets of sizes m and n, with c and d elements that other sets have, can be similar enough."""
    least = np.minimum(c, d)
    return whole * least >= part * (m + n - least)


def _chunks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, component, chunk: documents in chunks of about ``_CHUNK_ROWS``.

    A chunk's documents have the smallest document of their keys in common; a large component
    of these is cut into chunks of its own, small ones share chunks.
    """
    home = members.groupBy("rep").agg(F.min("center").alias("home"))
    named = home.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "home", F.coalesce("component", "rep").alias("component"))
    named = tables.stored(named, narrow=True)
    sizes = named.groupBy("home", "component").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") < _CHUNK_ROWS).groupBy("home").agg(F.sum("n").alias("small"))
    sizes = tables.stored(sizes.join(small, "home", "left"), narrow=True)
    large = F.col("n") >= _CHUNK_ROWS
    count = F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / _CHUNK_ROWS)
    spot = F.pmod(F.when(large, F.xxhash64("rep")).otherwise(F.xxhash64("component")), count)
    return named.join(sizes, ["home", "component"]).select(
        "rep", "component", F.xxhash64("home", F.when(large, F.col("component")), spot).alias("chunk")
    )


def _chunk_pairs(members: DataFrame, chunks: DataFrame, facts: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs of chunks (low, high) with a pair of documents that may be similar, share a key and aren't connected.

    Only keys with several components take part. All of a key but its largest component is held
    against all of it, by signatures and sizes; a large key is cut into cells of about 1,024 by
    1,024 documents.
    """
    named = tables.stored(members.join(chunks, "rep").select("key", "rep", "component", "chunk"), narrow=True)
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = tables.stored(
        sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("largest"))
        .filter("kinds > 1")
        .select(
            "key", F.col("largest.component").alias("largest"),
            F.ceil((F.col("n") - F.col("largest.n")) / _CELL).cast("int").alias("rows"), F.ceil(F.col("n") / _CELL).cast("int").alias("columns"),
        ),
        narrow=True,
    )
    placed = named.join(mixed, "key")
    spot = F.xxhash64("rep")
    left = placed.filter("component <> largest").withColumn("is_row", F.lit(True)).withColumn("row", F.pmod(spot, "rows").cast("int"))
    left = left.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    right = placed.withColumn("is_row", F.lit(False)).withColumn("column", F.pmod(spot, "columns").cast("int"))
    right = right.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    names = ["key", "row", "column", "is_row", "rep", "component", "chunk"]
    cells = tables.stored(left.select(names).unionByName(right.select(names)), narrow=True)
    parts = max(tables.partitions(members), cells.count() // 16384 + 1)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("row", "ascending"), ("column", "ascending")])
        cell = np.stack([table.column(x).to_numpy() for x in ("key", "row", "column")])
        begin = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)]))
        is_row, component, chunk, n, c = (table.column(x).to_numpy() for x in ("is_row", "component", "chunk", "n", "c"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, POSITIONS)
        found = set()
        for a, b in zip(begin, np.append(begin[1:], len(is_row))):
            right = a + np.flatnonzero(~is_row[a:b])
            for i in (a + np.flatnonzero(is_row[a:b])).tolist():
                j = right[(component[right] != component[i]) & _possible(n[i], c[i], n[right], c[right], part, whole)]
                if len(j):
                    j = j[(signature[j] != signature[i]).sum(axis=1) <= MOST_WRONG]
                    found.update((min(chunk[i], x), max(chunk[i], x)) for x in set(chunk[j].tolist()))
        found = sorted(found)
        return pa.table({"low": pa.array([x for x, _ in found], pa.int64()), "high": pa.array([x for _, x in found], pa.int64())})

    dealt = cells.join(facts, "rep").withColumn("part", F.pmod(F.xxhash64("key", "row", "column"), F.lit(parts)).cast("int"))
    return tables.groups_in_arrow(dealt, ["part"], compare, "low long, high long").distinct()


def _linked_across(pairs: DataFrame, chunks: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Confirmed links (a, b) between components in pairs of chunks; what a link connects isn't compared further."""
    sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("chunk"))
    rows = sides.join(chunks, "chunk").join(sets, "rep").select("low", "high", "chunk", "rep", "component", "n", "c", "shingles")

    def confirm(table: pa.Table) -> pa.Table:
        chunk, rep, component, n, c = (table.column(x).to_numpy() for x in ("chunk", "rep", "component", "n", "c"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
        held = np.concatenate([sets[j] for j in right])
        begin = np.cumsum(n[right]) - n[right]
        root = {x: x for x in component.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for i in left.tolist():
            open_ = (component[right] != component[i]) & _possible(n[i], c[i], n[right], c[right], part, whole)
            if not open_.any():
                continue
            place = np.minimum(np.searchsorted(sets[i], held), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][place] == held).astype(np.int64), begin)
            similar = open_ & (whole * both >= part * (n[i] + n[right] - both))
            for j in right[similar].tolist():
                x, y = find(int(component[i])), find(int(component[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((rep[i], rep[j]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return tables.groups_in_arrow(rows, ["low", "high"], confirm, "a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = 5, part: int = 75, whole: int = 100, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """For each row of ``docs``: its id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    Documents are linked where ``whole`` * intersection >= ``part`` * union of their sets of
    ``width``-word shingles (A-Z lower-cased; fewer words: the whole sequence is one shingle).
    Documents with equal sets are one class; classes meet by the keys described at the top of this
    module. A document of which too many shingles occur nowhere else is done. Of the rest, each
    key's smallest document is held against the others; then all that share a key, may be similar
    and aren't connected yet are tested, in pairs of chunks of documents, so that however many a
    key has, no pair of them becomes a row. Every link is confirmed on full sets, and links between
    what is connected already aren't looked for.

    Null or empty text: no shingles, linked with nothing. Null ids count as one id larger than
    all others and come back as null. Rows with equal ids are one document, linked with all that any of them
    is linked with; one without shingles stays by itself. No rows in, no rows out.
    """
    doc, text = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)), F.col(text_column)
    # inside, a row goes by its id and text: those of one id may differ
    plain = docs.select(F.xxhash64(doc, F.md5(text)).alias("id"), doc.alias("doc"), text.alias("text"))
    signed = tables.stored(_signed(plain, width))
    classes = tables.stored(
        signed.filter("n_shingles > 0").groupBy("p1", "p2").agg(F.min("id").alias("rep")),
        narrow=True,
    )
    reps = tables.stored(
        signed.join(classes, ["p1", "p2"]).filter("id = rep").select("rep", F.col("n_shingles").alias("n"), "signature").dropDuplicates(["rep", "n"]),
        narrow=True,
    )
    count = classes.count()
    parts = max(tables.partitions(docs), count * 1024 // (8 << 20) + 1)
    shared = tables.stored(_members(reps, parts))
    shared = shared.select("key", "rep").unionByName(shared.select("key", F.col("center").alias("rep"))).distinct()
    active = shared.select(F.col("rep").alias("id")).distinct()
    sets = _shared_counts(plain.join(active, "id", "left_semi"), width)
    # what no other document has counts against any link
    sets = tables.stored(sets.filter(F.col("c") * whole >= F.col("n") * part))
    facts = tables.stored(sets.select("rep", "n", "c").join(reps.select("rep", "n", "signature"), ["rep", "n"]), narrow=True)
    able = tables.stored(shared.join(facts.select("rep"), "rep"), narrow=True)
    centers = tables.stored(able.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("size")).filter("size > 1").drop("size"), narrow=True)
    members = tables.stored(able.join(centers, "key"), narrow=True)
    first = _close(members.filter("center <> rep").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), reps)
    owned = signed.filter("n_shingles > 0").join(classes, ["p1", "p2"]).select("doc", "rep").distinct()
    several = owned.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("doc", "a")
    same = owned.join(several, "doc").filter("rep > a").select("a", F.col("rep").alias("b"))
    links = tables.stored(_confirmed(first, sets, part, whole).unionByName(same), narrow=True)
    labels = tables.stored(components(links), narrow=True)
    chunks = tables.stored(_chunks(members, labels), narrow=True)
    pairs = tables.stored(_chunk_pairs(members, chunks, facts, part, whole), narrow=True)
    more = tables.stored(_linked_across(pairs, chunks, sets, part, whole), narrow=True)
    if not more.isEmpty():
        labels = tables.stored(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), narrow=True)
    least_doc = signed.filter("n_shingles > 0").groupBy("p1", "p2").agg(F.min("doc").alias("least"))
    grouped = classes.join(labels, F.col("rep") == F.col("node"), "left").join(least_doc, ["p1", "p2"])
    grouped = grouped.select("p1", "p2", "least", F.coalesce("component", "rep").alias("component"))
    least = grouped.groupBy("component").agg(F.min("least").alias("smallest"))
    found = grouped.join(least, "component").select("p1", "p2", "smallest")
    # sets without shingles have no class
    named = signed.select(F.col("doc").alias("id"), "n_shingles", "p1", "p2").join(found, ["p1", "p2"], "left")
    named = named.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("id")).alias("component"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return named.select(known("id").alias(id_column), "n_shingles", known("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
