"""Removal of lines that many documents share: explode, hash, count documents, drop, reassemble by position."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.tables import stored

WHITESPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITESPACE)), UPPER, LOWER)


def line_dedup(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Drop lines whose key at least ``min_docs`` documents hold, except in the largest id that holds it.

    Keys under ``min_chars`` code points are never dropped. Keys are compared by 128 bits of
    hashes. Documents are counted after (key, document) pairs are made distinct, with partial
    sums, so that a line of every third document is no larger than others; the join that marks
    lines moves ids and hashes only and may be split by adaptive execution. Texts are shuffled
    once, to meet the positions dropped from them.

    Returns the columns of ``docs`` with the text changed, and ``n_lines`` (before dropping) and
    ``n_dropped``, which replace input columns of these names. A null or empty text is one
    empty line and stays as it is. Rows with equal ids count as one document; all null ids as
    one that is larger than the others. No rows in, no rows out.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(id_column), F.lit((1 << 63) - 1)).cast("long").alias("id"),
        F.xxhash64(F.col(text_column)).alias("version"),
        F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1).alias("lines"),
    )
    lines = stored(
        rows.select("id", "version", F.posexplode("lines").alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    # written, so that both sides of the join below are plain shuffles, which adaptive execution can split
    shared = stored(
        lines.select("h1", "h2", "id").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
        .filter(F.col("n") >= min_docs).drop("n"),
        narrow=True,
    )
    dropped = (
        lines.join(shared, ["h1", "h2"]).filter(F.col("id") != F.col("keeper"))
        .groupBy("id", "version").agg(F.collect_set("pos").alias("dropped"))
    )
    last = F.size("lines") - 1
    kept = F.transform(F.array_except(F.sequence(F.lit(0), last), "dropped"), lambda i: F.get(F.col("lines"), i))
    text = F.when(F.col("dropped").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(f"row.`{text_column}`"))
    others = [c for c in docs.columns if c.lower() not in (text_column.lower(), "n_lines", "n_dropped")]
    judged = rows.join(dropped, ["id", "version"], "left").select(
        "row",
        text.alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return judged.select(
        *[F.col(f"row.`{c}`").alias(c) for c in others], F.col("text").alias(text_column), "n_lines", "n_dropped"
    )
