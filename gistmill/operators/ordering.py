"""Deterministic order: seeded shuffles, row numbers, heads, samples, batches.

Nothing here sorts a whole relation in one task. Row numbers are taken inside
small order-preserving buckets and lifted by the sizes of the buckets before.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill import fixed_values as fx
from gistmill.session import materialize

BUCKET_ROWS = 1 << 16
#: Consecutive rows that are sorted by length together, for batches of a token budget.
BLOCK_ROWS = 1024


def shuffle_key(seed: int, *columns: str) -> Column:
    """Hex digest that puts rows in an order that looks random and is always the same."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def shuffled(df: DataFrame, seed: int = fx.SHUFFLE_SEED, split: str = "split", key: str = "id") -> DataFrame:
    """Each split in seeded order (a range-partitioned sort, no single-task stage)."""
    return df.orderBy(split, shuffle_key(seed, split, key), key)


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    by: Sequence[str] = (),
    out: str = "position",
    same_rows: DataFrame | None = None,
) -> DataFrame:
    """1-based row numbers per ``by`` in ``order``, which must be a total order.

    ``bucket`` must never decrease along ``order``. It splits a group, however
    large, into pieces that are numbered in parallel. The relation is shuffled
    once, on (by, bucket); joining the bucket offsets back reuses that layout.
    Bucket sizes are counted on ``same_rows`` where that is cheaper to read.
    A null bucket or a null in ``by`` is an error: such rows have no place.
    """
    group = [F.col(name) for name in by]
    parts = df.withColumn("_bucket", bucket)
    counted = parts if same_rows is None else same_rows.withColumn("_bucket", bucket)
    sizes = counted.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = parts.withColumn("_rank", F.row_number().over(inside))
    # a null finds no offset: an inner join would lose its row without a word
    nowhere = F.raise_error(F.lit(f"null bucket or group in {[*by]}")).cast("bigint")
    return (
        numbered.join(offsets, [*by, "_bucket"], "left")
        .withColumn(out, F.coalesce("_offset", nowhere) + F.col("_rank"))
        .drop("_bucket", "_rank", "_offset")
    )


def bucket_digits(rows: int) -> int:
    """Hex digits that cut ``rows`` of uniform digests into buckets of ``BUCKET_ROWS`` or fewer."""
    digits = 2
    while rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def shuffle_buckets(
    df: DataFrame, seed: int = fx.SHUFFLE_SEED, keys: Sequence[str] = ("split", "id"), prefix: int | None = None
) -> DataFrame:
    """Add the shuffle ``_key`` and its first hex digits as ``_bucket``.

    Digests are uniform, so this makes up to 16**prefix buckets of equal size. Without
    a prefix the rows are counted, and buckets have about ``BUCKET_ROWS`` at most.
    """
    if prefix is None:
        prefix = bucket_digits(df.count())
    keyed = df.withColumn("_key", shuffle_key(seed, *keys))
    return keyed.withColumn("_bucket", F.substring("_key", 1, prefix))


def number_shuffled(
    df: DataFrame,
    seed: int = fx.SHUFFLE_SEED,
    keys: Sequence[str] = ("split", "id"),
    by: Sequence[str] = ("split",),
    prefix: int | None = None,
    out: str = "position",
) -> DataFrame:
    """Position of each row in the seeded order of its split."""
    keyed = shuffle_buckets(df, seed, keys, prefix)
    order = [F.col("_key"), *[F.col(k) for k in keys]]
    return number_rows(keyed, order, F.col("_bucket"), by, out).drop("_key")


def rank_rows(df: DataFrame, order: Sequence[Column], out: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """1-based row numbers per ``by`` for an order without natural buckets, however large a group is.

    Range partitions serve as buckets. They come from sampling, so the layout
    is fixed by a checkpoint before their sizes are counted.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    return number_rows(materialize(ranged), order, F.col("_range"), by, out).drop("_range")


def head(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """First ``n`` rows in order; 0 means all."""
    return df.orderBy(order).limit(n) if n else df


def sample_rows(df: DataFrame, k: int, seed: int = fx.EXAMPLE_SEED, key: str = "id") -> DataFrame:
    """``k`` rows without replacement; an error if there are fewer."""
    picked = materialize(df.orderBy(shuffle_key(seed, key), key).limit(k))
    found = picked.count()
    if found < k:
        raise ValueError(f"sample larger than population: asked for {k} rows, found {found}")
    return picked


def assign_batches(df: DataFrame, batch_size: int, position: str = "position") -> DataFrame:
    """Consecutive rows share a ``batch_id``; only the last batch may be short."""
    return df.withColumn("batch_id", F.expr(f"({position} - 1) div {batch_size}"))


def assign_token_batches(
    df: DataFrame,
    budget: int,
    length: str,
    position: str = "position",
    by: Sequence[str] = ("split",),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Batches of rows of alike length whose padded tokens, longest times rows, stay within ``budget``.

    ``block_rows`` consecutive positions are a block: random rows, if positions follow a seeded shuffle. Within a
    block the longest rows come first, and a batch takes as many as its first row, the longest, allows; a row
    longer than the budget is a batch of its own. Adds ``batch_id`` (from 0 in each ``by``, in the order
    of blocks) and ``longest``. A missing length counts as 0.

    Blocks are bounded and independent: lengths alone are gathered by block, and rows meet their block's
    batches in the layout in which they were ranked. ``df`` is read twice, so it should be a written table.
    """
    group = [F.col(name) for name in by]
    tokens = F.coalesce(F.col(length), F.lit(0)).cast("bigint")
    blocks = df.withColumn("_block", F.expr(f"({position} - 1) div {block_rows}"))
    descending = F.sort_array(F.collect_list(tokens), asc=False)
    gathered = blocks.groupBy(*group, "_block").agg(descending.alias("_lengths"))

    def step(state: Column, tokens: Column) -> Column:
        opens, row = state["row"] == state["next"], state["row"] + 1
        rows = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.greatest(tokens, F.lit(1))))
        first = F.struct(state["row"].alias("row"), tokens.alias("longest"))
        return F.struct(
            row.alias("row"),
            F.when(opens, state["row"] + rows).otherwise(state["next"]).alias("next"),
            F.when(opens, F.concat(state["firsts"], F.array(first))).otherwise(state["firsts"]).alias("firsts"),
        )

    none = F.array().cast("array<struct<row:bigint,longest:bigint>>")
    begin = F.struct(F.lit(1).cast("bigint").alias("row"), F.lit(1).cast("bigint").alias("next"), none.alias("firsts"))
    cut = gathered.select(*group, "_block", F.aggregate("_lengths", begin, step, lambda state: state["firsts"]).alias("_firsts"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_offset", F.coalesce(F.sum(F.size("_firsts")).over(before), F.lit(0)))
    inside = Window.partitionBy(*group, "_block").orderBy(tokens.desc(), position)
    ranked = blocks.withColumn("_rank", F.row_number().over(inside)).join(cut, [*by, "_block"])
    batch = F.size(F.filter("_firsts", lambda first: first["row"] <= F.col("_rank")))
    placed = ranked.withColumn("_batch", batch)
    return placed.withColumns({
        "batch_id": F.col("_offset") + F.col("_batch") - 1,
        "longest": F.element_at("_firsts", F.col("_batch"))["longest"],
    }).drop("_block", "_rank", "_firsts", "_offset", "_batch")


def padding_share(batched: DataFrame, length: str, by: Sequence[str] = ("split",)) -> DataFrame:
    """``(by, batches, tokens, padding)``: what padding to the longest of each batch adds to the tokens."""
    sizes = batched.groupBy(*by, "batch_id").agg(
        F.sum(length).alias("tokens"), (F.max(length) * F.count(length)).cast("bigint").alias("padded")
    )
    return sizes.groupBy(*by).agg(
        F.count("*").alias("batches"), F.sum("tokens").alias("tokens"), F.sum(F.col("padded") - F.col("tokens")).alias("padding")
    )
