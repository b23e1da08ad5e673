"""End-to-end flows. Each reads tables, composes operators and writes tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill import fixed_values as fx
from gistmill.functions.text import word_count
from gistmill.operators import metrics as m
from gistmill.operators.ordering import assign_batches, assign_token_batches, number_rows, shuffle_buckets, shuffled
from gistmill.operators.prepare import prepare_records, split_sizes
from gistmill.operators.profile import profile_report
from gistmill.operators.results import mean_output_words, results_table
from gistmill.operators.tokens import PAD_ID, pad_batches, training_examples, vocabulary, with_longest
from gistmill.functions.chat import render_example
from gistmill.sources import records as record_io
from gistmill.sources import runs as run_io
from gistmill.session import materialize


def prepare_corpus(raw: DataFrame, out: str, source_name: str, order: str = "pos", fmt: str = "parquet") -> DataFrame:
    """Write shuffled, clean, distinct records per split; return the split sizes."""
    record_io.write_records(shuffled(prepare_records(raw, source_name, order)), out, fmt)
    return split_sizes(record_io.read_records(raw.sparkSession, out, fmt))


def score_run(predicted: DataFrame, name: str, vectors: DataFrame | None = None, stem: bool = True) -> DataFrame:
    """One metrics row per split for records that carry ``prediction`` and ``summary``."""
    scored = m.score_pairs(predicted, "prediction", "summary", stem)
    scores = list(m.ROUGE)
    if vectors is not None:
        matched = m.embedding_f1(predicted, vectors, ["split", "id"], "prediction", "summary")
        scored = scored.join(matched, ["split", "id"])
        scores.append("bertscore_f1")
    return m.corpus_scores(scored.withColumn("name", F.lit(name)), ("name", "split"), scores)


def predict_and_score(
    records: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    name: str,
    predictions_path: str,
    metrics_path: str,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Write a run's predictions, score what was written, write and return the metrics."""
    spark = records.sparkSession
    run_io.write_predictions(predict(records), predictions_path, name)
    written = run_io.read_predictions(spark, predictions_path).filter(F.col("name") == name)
    m.check_aligned(written, records)
    run_io.write_metrics(score_run(written.drop("name"), name, vectors), metrics_path)
    return run_io.read_metrics(spark, metrics_path).filter(F.col("name") == name)


def training_batches(
    records: DataFrame,
    pad_id: int = PAD_ID,
    vocab: DataFrame | None = None,
    tokenize: Callable[[Column], Column] | None = None,
    max_length: int = fx.TRAINING_MAX_LENGTH,
    batch_size: int = fx.BATCH_SIZE,
    seed: int = fx.SHUFFLE_SEED,
    token_budget: int | None = None,
) -> DataFrame:
    """Padded batches of masked examples, in seeded order within each split.

    With a ``token_budget`` batches are of alike lengths and bounded by padded tokens, not by ``batch_size``.

    Ids are cut before they are shuffled, once by ranges of the seeded order for numbering. Batches then take the
    second shuffle, of ids alone; masks and labels are added after it. Beyond a broadcast vocabulary, numbers and batches are
    found for the examples' keys and lengths, and ids are not shuffled for them.
    """
    if vocab is None and tokenize is None:
        rendered = records.select(render_example(F.col("abstract"), F.col("summary")).alias("text"))
        vocab = vocabulary(rendered, "text")
    keyed = shuffle_buckets(records, seed)
    order = [F.col("_key"), F.col("id")]

    def place(examples: DataFrame, length: Column) -> DataFrame:
        numbered = number_rows(examples, order, F.col("_bucket"), ["split"], same_rows=keyed).drop("_key")
        if token_budget is not None:
            written = materialize(numbered.withColumn("n_tokens", length))
            return assign_token_batches(written, token_budget, "n_tokens")
        return with_longest(assign_batches(numbered, batch_size), length, out="_batch_longest")

    batched = training_examples(
        keyed, vocab, tokenize, max_length=max_length, keys=("split", "_bucket", "_key", "id"), masked=False, place=place,
    )
    longest = "_batch_longest" if token_budget is None else "longest"
    return pad_batches(batched, pad_id, longest=longest).drop("_batch_longest")


def corpus_profile(records: DataFrame, out: str, length: Callable[[Column], Column] = word_count) -> DataFrame:
    report = profile_report(records, length)
    run_io.write_report(report, out)
    return report


def run_results(metrics: DataFrame, predictions: DataFrame, display: DataFrame, include_deprecated: bool = False) -> DataFrame:
    words = materialize(mean_output_words(predictions))
    return results_table(metrics, words, display, include_deprecated)
