"""Inputs of the operators, derived by Spark from the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.functions.rouge import rouge_words, word_array
from gistmill.functions.text import first_sentence
from gistmill.functions.text import sentences as split_sentences
from gistmill.operators.ordering import rank_rows
from gistmill.operators.prepare import prepare_records
from gistmill.session import compute_once, materialize, spread

SOURCE_NAME = "documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines are sentences; its last line is the summary."""
    turn, lines = F.col("doc_id") % 10, F.col("lines")
    return compute_once(documents(spark, sf_dir), lines=F.split("text", "\n")).select(
        F.col("doc_id").alias("pos"),
        F.when(turn == 0, "validation").when(turn == 1, "test").otherwise("train").alias("split"),
        F.slice(lines, 1, F.size(lines) - 1).alias("source"),
        F.slice(lines, -1, 1).alias("target"),
    )


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_records(raw_papers(spark, sf_dir), SOURCE_NAME)


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared records as a written table, for queries that read them more than once."""
    return materialize(prepared(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn (reference) and the assistant turn right after it (prediction).

    Turns are numbered, so the next turn is found by an equi-join on
    (conv_id, turn) and not by a window over a conversation of any length.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("prediction")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), "reference", "prediction"
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictions for every prepared record, in long form."""
    records = prepared(spark, sf_dir)
    words = F.split("abstract", " ")
    sentences = split_sentences(F.col("abstract"))
    predictions = {
        "extractive_first_sentence": first_sentence(F.col("abstract")),
        "lead_20_words": F.array_join(F.slice(words, 1, 20), " "),
        "qlora_last_sentence": F.element_at(sentences, -1),
    }
    named = [F.struct(F.lit(n).alias("name"), p.alias("prediction")) for n, p in predictions.items()]
    return records.select("split", "id", "summary", F.inline(F.array(*named)))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user, one step per event; which metric was logged depends on the event."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    kind = F.col("event_type")
    numbered = rank_rows(events, [F.col("ts"), F.col("event_id")], out="step", by=["user_id"])
    return numbered.select(
        F.col("user_id").cast("string").alias("run_id"),
        "step",
        F.when(kind.isin("view", "click", "purchase"), F.col("value")).alias("train_loss"),
        F.when(kind == "signup", F.col("value")).alias("eval_loss"),
        F.when(kind == "error", F.col("value")).alias("learning_rate"),
    )


def wrapped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn inside one of eight kinds of chat boilerplate."""
    said = F.col("text")
    kind = (F.col("conv_id") + F.col("turn")) % 8
    wrappers = [
        ("Here's the TL;DR:\n", ""),
        ("  Sure! Here is a plain-language tl;dr — ", "\n"),
        ("Summary of the text:\n\n", "  "),
        ('"', '"'),
        ("“", "”"),
        ("*", "*"),
        ("**", "**"),
        ("Here’s my brief TLDR:\n\n\"", "\""),
    ]
    completion = F.lit(None).cast("string")
    for number, (before, after) in enumerate(wrappers):
        wrapped = F.concat(F.lit(before), said, F.lit(after))
        completion = F.when(kind == number, wrapped).otherwise(completion)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", completion.alias("completion"))


def token_vectors(spark: SparkSession, sf_dir: str, texts: DataFrame, *columns: str) -> DataFrame:
    """A vector for every word of the texts: words and vectors are numbered, and words go round all vectors."""
    words = texts.select(
        F.explode(F.concat(*[word_array(rouge_words(F.col(c))) for c in columns])).alias("token")
    ).distinct()
    ranked = rank_rows(words, [F.col("token")], out="rank")
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    numbered = rank_rows(embeddings, [F.col("vec_id")], out="number")
    number = (F.col("rank") - 1) % embeddings.count() + 1
    joined = ranked.withColumn("number", number).join(numbered, "number")
    return materialize(joined.select("token", "vector"))
