"""Bounded samples of labelled texts, and models trained on them in one task."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.tables import in_arrow


def remainder(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % parts


def trained(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str,
    usable: Column,
    fit: Callable[[list[str], list[int]], bytes],
    rows_each: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> bytes:
    """The model that ``fit(texts, labels)`` makes of labelled texts.

    At most ``rows_each`` rows of each label, those with the smallest hashes of their ids, are
    learnt from; their ids (16 bytes each) are broadcast to find the texts, which meet in one
    task in the order of their hashes. Only the model comes to the driver. Rows with a null
    id, label or text, or a label other than 0 and 1, aren't learnt from.
    """
    known = labels.filter(usable).select(
        F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"), F.xxhash64(id_column).alias("at")
    ).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    sides = [known.filter(F.col("label") == y).orderBy("at", "id").limit(rows_each) for y in (0, 1)]
    sample = sides[0].unionByName(sides[1])
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter(F.col("text").isNotNull())
    chosen = texts.join(F.broadcast(sample), "id").repartition(1).sortWithinPartitions("at", "id", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            marks += batch.column("label").to_pylist()
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit(texts, marks)], pa.binary())})

    rows = in_arrow(chosen.select("text", "label"), learn, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else fit([], [])
