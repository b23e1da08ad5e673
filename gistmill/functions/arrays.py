"""Token-id arrays: truncation, prompt masking, padding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed_values as fx


def truncate(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def completion_labels(ids: Column, prompt_length: Column) -> Column:
    """``ids`` with the first ``prompt_length`` entries hidden from the loss."""
    hidden = F.least(prompt_length, F.size(ids))
    return F.concat(
        F.array_repeat(F.lit(fx.IGNORED_LABEL), hidden).cast("array<bigint>"),
        F.slice(ids, hidden + 1, F.size(ids)).cast("array<bigint>"),
    )


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def pad_right(values: Column, length: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), length - F.size(values))).cast("array<bigint>")


def pad_left(values: Column, length: Column, fill: int) -> Column:
    return F.concat(F.array_repeat(F.lit(fill), length - F.size(values)), values).cast("array<bigint>")
