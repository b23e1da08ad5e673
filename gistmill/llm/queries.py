"""The registered queries of this subpackage: one for each operator, over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm.bpe import encode_digests
from gistmill.llm.fertility import fertility_rules
from gistmill.llm.jaccard_join import jaccard_join
from gistmill.llm.learning import remainder
from gistmill.llm.line_dedup import line_dedup
from gistmill.llm.main_text import main_text
from gistmill.llm.near_dedup import near_duplicates
from gistmill.llm.packing import pack_sequences
from gistmill.llm.prefix_trie import conversation_trie
from gistmill.llm.quality import quality_scores
from gistmill.llm.substring_dedup import substring_dedup
from gistmill.llm.toxicity import toxicity_scores
from gistmill.llm.vector_search import top_k
from gistmill.llm.whitening import whiten

#: A text is predicted to have label 1 from this score on.
THRESHOLD = 0.3

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)


def _scored(spark: SparkSession, sf_dir: str, score: Callable, parts: int, held: int) -> DataFrame:
    held_out = remainder("doc_id", parts) == held
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, labels, ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality_scores, 5, 0)


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return fertility_rules(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("lang")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity_scores, 4, 2)


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def all_queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
