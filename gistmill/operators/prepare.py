"""Raw papers -> clean, identified, deduplicated, split records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill import fixed_values as fx
from gistmill.functions.text import content_id, squeeze_whitespace
from gistmill.session import compute_once


def split_name(split: Column) -> Column:
    named = split
    for old, new in fx.SPLIT_RENAMES.items():
        named = F.when(split == old, F.lit(new)).otherwise(named)
    return named


def clean_papers(raw: DataFrame, source_name: str, order: str = "pos") -> DataFrame:
    """``(split, source[], target[], pos)`` -> ``(split, id, abstract, summary, source, pos)``.

    Drops rows without sentences or without a summary, and rows whose cleaned
    texts are too short. A null sentence inside ``source`` is skipped.
    """
    usable = raw.filter((F.size("source") > 0) & (F.size("target") > 0))
    cleaned = compute_once(
        usable.select(F.col(order).alias("pos"), split_name(F.col("split")).alias("split"), "source", "target"),
        abstract=squeeze_whitespace(F.array_join("source", " ")),
        summary=squeeze_whitespace(F.col("target")[0]),
    )
    long_enough = (F.length("abstract") >= fx.MIN_ABSTRACT_CHARS) & (F.length("summary") >= fx.MIN_SUMMARY_CHARS)
    return cleaned.filter(long_enough).select(
        "split",
        content_id(F.col("abstract")).alias("id"),
        "abstract",
        "summary",
        F.lit(source_name).alias("source"),
        "pos",
    )


def keep_first(records: DataFrame, order: str = "pos", text: str = "abstract") -> DataFrame:
    """One record per split and text: the first in ``order``, which must tell rows apart.

    Texts are told apart by their whole digest. Digests and positions are aggregated
    first, and texts then only pick out the rows that were first: they are hashed
    against that narrow table and never sorted. If different texts of a split share an id
    (its digits are too few), all but the one of the smallest digest are known by the whole digest.
    """
    digest = F.sha2(text, 256)
    firsts = records.groupBy("split", digest.alias("_digest")).agg(F.min(order).alias("_first"))
    short = F.substring("_digest", 1, fx.ID_HEX_CHARS)
    holder = F.min("_digest").over(Window.partitionBy("split", short))
    named = firsts.select(
        F.col("split").alias("_split"), "_digest", "_first", F.when(F.col("_digest") == holder, short).otherwise(F.col("_digest")).alias("_id")
    )
    matches = (F.col("split") == F.col("_split")) & (digest == F.col("_digest")) & (F.col(order) == F.col("_first"))
    kept = records.join(named.hint("shuffle_hash"), matches)
    return kept.select(*[F.col("_id").alias("id") if c == "id" else c for c in records.columns])


def prepare_records(raw: DataFrame, source_name: str, order: str = "pos") -> DataFrame:
    return keep_first(clean_papers(raw, source_name, order))


def split_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
