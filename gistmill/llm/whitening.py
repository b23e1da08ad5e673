"""Whitening of vectors by shifted Cholesky QR.

With A the centred rows, each pass sums the Gram matrix of the present rows over the cluster,
the driver factors it (d x d numbers), and the next pass turns rows into R^-T rows by
triangular solves. The first factors are shifted, so that they exist however badly A is conditioned; passes
go on until the Gram matrix is the identity. A = Q R then, with R the product of all factors, and the singular
values and right vectors of R are those of A: components without the squared condition of a
covariance.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import tables

BLOCK_ROWS, MOST_PASSES = 4096, 16
_SMALLEST = 2.0**-52


def _packed(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """Usable vectors of one length in blocks: length, ids, x as 64-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                lists = batch.column("vector")
                sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
                values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
                begin = np.cumsum(sizes) - sizes
                bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
                usable = (bad[begin + sizes] == bad[begin]) & np.asarray(lists.is_valid()) & (sizes > 0)
                for size in np.unique(sizes[usable]).tolist():
                    rows = np.flatnonzero(usable & (sizes == size))
                    x = np.floor(scale * values[begin[rows][:, None] + np.arange(size)]) + offset
                    if np.abs(x).max() >= 2.0**53:
                        raise ValueError("a vector has an entry beyond what is exact")
                    yield pa.RecordBatch.from_pydict({
                        "size": pa.array([size], pa.int32()),
                        "ids": pa.array([batch.column("id").take(pa.array(rows))], pa.list_(pa.int64())),
                        "x": pa.array([x.astype(np.int64).tobytes()]),
                    })

    return tables.stored(tables.in_arrow(vectors, pack, "size int, ids array<long>, x binary"))


def _deviations(body: pa.Scalar, size: int, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers where all fit, else Python's."""
    x = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, size)
    if n * int(np.abs(x).max()) + max(abs(s) for s in sums) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The Q of ``rows`` = Q R, for upper triangular R: column after column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _summed(blocks: DataFrame, fits: dict[int, tuple[int, list[int]]], turn: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each length the sum of rows^T rows over all blocks, of centred rows that ``turn(size, rows)`` maps."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, body in zip(batch.column("size").to_pylist(), batch.column("x")):
                n, sums = fits[size]
                rows = turn(size, (_deviations(body, size, n, sums) / n).astype(float))
                gram = rows.T @ rows
                held[size] = held[size] + gram if size in held else gram
        for size, gram in held.items():
            i, j = np.triu_indices(len(gram))
            yield pa.RecordBatch.from_pydict({
                "size": pa.array(np.full(len(i), size), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "g": pa.array(gram[i, j]),
            })

    entries = tables.in_arrow(blocks.select("size", "x"), add, "size int, i int, j int, g double")
    out: dict[int, np.ndarray] = {}
    found: dict[int, list] = {}
    for row in entries.groupBy("size", "i", "j").agg(F.sum("g").alias("g")).collect():
        found.setdefault(row["size"], []).append((row["i"], row["j"], row["g"]))
    for size, cells in found.items():
        width = 1 + max(j for _, j, _ in cells)
        out[size] = np.zeros((width, width))
        for i, j, g in cells:
            out[size][i, j] = out[size][j, i] = g
    return out


def _factored(gram: np.ndarray) -> tuple[np.ndarray, bool]:
    """A factor F with F^T F = Gram (and shift), and whether the rows it leaves are orthonormal, or null in a direction."""
    values, vectors = np.linalg.eigh(gram)
    if (np.abs(values - 1) < 1e-8).all():
        return np.linalg.cholesky(gram).T, True
    if ((np.abs(values - 1) < 1e-8) | (values < 1e-14)).all():
        # directions in which rows differ by less than rounding, after the shift let them grow by 10^5, are null
        return (vectors * np.sqrt(np.where(values < 1e-14, 0.0, values))) @ vectors.T, True
    d = len(gram)
    shift = 0.0 if values[0] > 1e-6 * values[-1] else 11 * d * (BLOCK_ROWS + d + 1) * _SMALLEST * np.trace(gram)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T, False


def _components(blocks: DataFrame, fits: dict[int, tuple[int, list[int]]], count: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: unit components as columns, their eigenvalues, and shares of the whole variance."""
    factors: dict[int, list[np.ndarray]] = {size: [] for size in fits}
    done: dict[int, np.ndarray] = {}
    for _ in range(MOST_PASSES):
        open_ = {size: x for size, x in factors.items() if size not in done}
        if not open_:
            break

        def turn(size: int, rows: np.ndarray) -> np.ndarray:
            for factor in open_[size]:
                rows = _solved(rows, factor)
            return rows

        some = blocks.filter(F.col("size").isin(list(open_))) if len(open_) < len(fits) else blocks
        for size, gram in _summed(some, fits, turn).items():
            if not factors[size] and not np.trace(gram) > 0:
                done[size] = np.zeros((size, size))
                continue
            factor, last = _factored(gram)
            if last:
                composed = np.eye(size)
                for x in [*factors[size], factor]:
                    composed = x @ composed
                done[size] = composed
            else:
                factors[size].append(factor)
    if len(done) < len(fits):
        raise ValueError(f"no orthogonal rows after {MOST_PASSES} passes")
    out = {}
    for size, composed in done.items():
        _, singular, right = np.linalg.svd(composed)
        right = right[:count].T
        right = right * np.where(right[np.abs(right).argmax(axis=0), np.arange(right.shape[1])] < 0, -1, 1)
        # a length that rounding alone could give is none
        singular = np.where(singular > singular.max() * size * 4 * _SMALLEST, singular, 0.0)
        values = singular**2 / fits[size][0]
        total = values.sum()
        out[size] = right, values[:count], values[:count] / total if total else np.zeros(min(count, size))
    return out


def whiten(
    vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """A row for each usable row of ``vectors`` and each of its first ``components`` principal components.

    Entries c become x = floor(scale * c) + offset. Columns: the id; ``component`` (from 1, by falling
    eigenvalue); ``n`` vectors fitted; ``deviation``, the sum over dimensions of (n * x - S)^2, S the
    sums of x, exact (decimal); ``whitened``, the centred x on the component over the root of its eigenvalue;
    ``explained``, that eigenvalue's share of the variance; ``identity_error``, how far the
    covariance of ``whitened`` is from the identity at most.

    Sums of integers are exact; Gram entries are summed by Spark, d * (d + 1) / 2 numbers a task, and
    only those and the sums reach the driver. No pass holds more than a block of 4,096 rows.

    A row takes no part if its vector is null, empty, or holds null or non-finite entries; its id may be null.
    Repeated rows count each time. Vectors of different lengths are whitened apart. A component
    with no variance (equal rows, dependent dimensions, fewer rows than components; lengths below some 10^-12 of the largest) has a null
    ``whitened`` and takes no part in ``identity_error`` (null if there is no other). An entry of x beyond 2^53 raises an
    error. Other columns don't matter. No rows in, no rows out.
    """
    blocks = _packed(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")), scale, offset)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, body in zip(batch.column("size").to_pylist(), batch.column("x")):
                x = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, size)
                yield pa.RecordBatch.from_pydict({
                    "size": pa.array([size] * size, pa.int32()), "i": pa.array(range(size), pa.int32()),
                    "n": pa.array([len(x)] * size, pa.int64()), "s": pa.array([str(s) for s in x.astype(object).sum(axis=0)]),
                })

    sums = tables.in_arrow(blocks.select("size", "x"), total, "size int, i int, n long, s string")
    sums = sums.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    fits: dict[int, tuple[int, list[int]]] = {}
    for row in sums.orderBy("size", "i").collect():
        fits.setdefault(row["size"], (row["n"], []))[1].append(int(row["s"]))
    found = _components(blocks, fits, components)

    def turned(size: int, rows: np.ndarray) -> np.ndarray:
        right, values, _ = found[size]
        return np.divide(rows @ right, np.sqrt(values), out=np.zeros((len(rows), len(values))), where=values > 0)

    # a column of ones beside the rows gives their sums with their products
    errors: dict[int, float | None] = {}
    for size, gram in _summed(blocks, fits, lambda size, rows: np.hstack([turned(size, rows), np.ones((len(rows), 1))])).items():
        k, live = len(found[size][1]), found[size][1] > 0
        mean = gram[:k, k] / gram[k, k]
        off = gram[:k, :k] / gram[k, k] - np.outer(mean, mean) - np.eye(k)
        errors[size] = float(np.abs(off[live][:, live]).max()) if live.any() else None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, ids, body in zip(batch.column("size").to_pylist(), batch.column("ids"), batch.column("x")):
                n, sums = fits[size]
                own = _deviations(body, size, n, sums)
                squares = (own.astype(object) ** 2).sum(axis=1) if own.dtype == object or size * int(np.abs(own).max()) ** 2 >= 1 << 62 else (own * own).sum(axis=1)
                _, values, shares = found[size]
                white, k = turned(size, (own / n).astype(float)), len(values)
                yield pa.RecordBatch.from_pydict({
                    id_column: ids.values.take(pa.array(np.repeat(np.arange(len(own)), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), len(own)), pa.int32()),
                    "n": pa.array(np.full(len(own) * k, n), pa.int64()),
                    "deviation": pa.array([str(s) for s in np.repeat(squares, k).tolist()]),
                    "whitened": pa.array(white.ravel(), mask=np.tile(values <= 0, len(own))),
                    "explained": pa.array(np.tile(shares, len(own))),
                    "identity_error": pa.array([errors[size]] * (len(own) * k), pa.float64()),
                })

    schema = f"`{id_column}` long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    return tables.in_arrow(blocks, emit, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
