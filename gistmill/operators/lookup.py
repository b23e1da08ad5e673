"""Joins of very many rows with a table that is unique on the key.

The table is broadcast only if it was measured to be small. Beyond that, the few
keys that have many rows are broadcast, and the rest is joined by shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.session import materialize

BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1000


def fits_broadcast(table: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Measure the table (one small job) instead of trusting an estimate."""
    measured = table.agg(F.sum(row_bytes + 16)).first()[0]
    return (measured or 0) <= limit


def broadcast_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return rows.join(F.broadcast(table), key, "left")


def frequent_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join by shuffle, frequent keys by broadcast.

    Keys of more than 1/1000 of all rows are counted on the rows themselves: there are fewer
    than 1000 of them, which bounds the list that is broadcast, and those that the
    table doesn't have are among them. Their rows never reach the shuffle, so no key there
    brings more than a thousandth of all rows to a task. Nulls are frequent too: they match nothing.
    """
    counts = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    frequent = counts.filter(F.col(key).isNotNull() & (F.col("_n") > total / HOT_KEYS)).select(key)
    hot = materialize(frequent.join(table, key, "left"))
    known = rows.join(F.broadcast(hot), key)
    tail = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, "left")
    values = [c for c in table.columns if c != key]
    missing = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in values])
    return known.unionByName(tail).unionByName(missing)
