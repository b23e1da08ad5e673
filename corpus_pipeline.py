"""From raw documents to packed training sequences, stage by stage."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm.learning import remainder
from gistmill.llm.line_dedup import line_dedup
from gistmill.llm.near_dedup import near_duplicates
from gistmill.llm.packing import pack_sequences
from gistmill.llm.queries import THRESHOLD
from gistmill.llm.substring_dedup import substring_dedup
from gistmill.llm.tables import stored
from gistmill.llm.toxicity import toxicity_scores



def _applied(operator: Callable[[DataFrame], DataFrame], docs: DataFrame, changed: bool = True) -> DataFrame:
    """What ``operator`` makes of ids and texts, with the columns of ``docs``, whatever their names.

    If texts are ``changed``, ``n_chars`` follows them, where there is such a column. Ids and texts travel once: only the
    other columns go with them as one.
    """
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if changed and "n_chars" in docs.columns:
        own["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    packed = operator(docs.select("doc_id", "text", *([F.struct(*others).alias("_row")] if others else [])))
    return packed.select(*[own.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic, unchanged.

    Null, empty and wordless texts stay, and repeated rows share their fate. If the labels that may be learnt from are
    of one kind or none, nothing can be predicted and all documents stay. No rows in, no rows out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = lambda x: toxicity_scores(x, labels, remainder("doc_id", 4) != 2, untrained=0.0).filter(F.col("score") < THRESHOLD)
    return _applied(score, docs, changed=False)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many share.

    A null or empty text stays as it is; a document may become empty and stays. Rows of equal id count as one document, all
    null ids as one with the largest id. No rows in, no rows out.
    """
    return _applied(line_dedup, docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, unchanged: the one with the smallest id.

    Null and empty texts are near nothing and stay. Rows of one id are one document: all of them stay or go. Null ids are
    one id, the largest. No rows in, no rows out.
    """
    found = near_duplicates(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.min("component_id").alias("_least"))
    # an empty row beside others of its id is its own component: the id's smallest decides
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("_least")) | F.col("_least").isNull()).select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has.

    Null, empty and short texts stay as they are; a document may become empty and stays. Rows of equal id don't take from
    each other; a null id is the largest. No rows in, no rows out.
    """
    return _applied(substring_dedup, docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens goes in the training sequences.

    A null or empty text is one piece, its end; every row is packed, repeated ones and null ids too. No rows in, no rows out.
    """
    return pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _lines),
    ("near_dedup", _near_duplicates),
    ("substring_dedup", _substrings),
    ("packing", _packing),
]
#: SQL can't express a learnt classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
