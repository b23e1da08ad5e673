"""Registered queries: one per operator, each over whole driver tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill import fixed_values as fx
from gistmill.functions import chat, text
from gistmill.operators import history as h
from gistmill.operators import metrics as m
from gistmill.operators import ordering as o
from gistmill.operators import predict as p
from gistmill.operators import prepare as prep
from gistmill.operators import profile as prof
from gistmill.operators import results as res
from gistmill.operators import tokens as tok
from gistmill.plans import inputs
from gistmill.plans.flows import corpus_profile, run_results, training_batches
from gistmill.session import materialize, new_folder
from gistmill.sources import records as record_io
from gistmill.sources import runs as run_io

Query = Callable[[SparkSession, str], DataFrame]
#: name, variant, model, rank
RUN_FACTORS = [
    ("extractive_first_sentence", "sentence", "extractive", 0),
    ("lead_20_words", "words", "extractive", 0),
    ("qlora_last_sentence", "sentence", "tuned", 8),
]
#: (inputs, outputs) of a layer's adapted matrices, and the layers
ADAPTED, LAYERS = ((512, 512), (512, 128), (512, 128), (512, 512), (512, 1408), (512, 1408), (1408, 512)), 12
RUN_LABELS = {
    "extractive_first_sentence": "First sentence",
    "qlora_last_sentence": "Last sentence",
}


def _joined(ids: str) -> Column:
    """Arrays leave the queries as text, which every engine compares alike. JSON makes no string of each number; none is null."""
    return F.btrim(F.replace(F.to_json(ids), F.lit(","), F.lit(" ")), F.lit("[]")).alias(ids)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Means depend on summation order in their last digits."""
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


# --- corpus preparation -------------------------------------------------------


def prepare_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.clean_papers(inputs.raw_papers(spark, sf_dir), inputs.SOURCE_NAME)


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.prepared(spark, sf_dir)


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.split_sizes(inputs.prepared(spark, sf_dir))


def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.number_shuffled(materialize(inputs.prepared(spark, sf_dir).select("split", "id")))


def shuffle_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.example_rows(inputs.prepared(spark, sf_dir).filter(F.col("split") == "train"))


def head_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = inputs.prepared(spark, sf_dir).filter(F.col("split") == "val").select("pos", "id", "abstract", "summary")
    return o.head(dev, fx.EVAL_SUBSET_ROWS)


# --- predictions ----------------------------------------------------------------


def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.documents(spark, sf_dir).select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


def strip_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.wrapped_answers(spark, sf_dir).select(
        "conv_id", "turn", text.clean_completion(F.col("completion")).alias("cleaned")
    )


def render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pairs(spark, sf_dir).select(
        "conv_id", "turn",
        chat.render_example(F.col("reference")).alias("prompt"),
        chat.render_example(F.col("reference"), F.col("prediction")).alias("full"),
    )


def _first_sentence_model():
    """A deterministic stand-in for a language model: answers with the abstract's first sentence."""
    import re

    boundary = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")  # fx.SENTENCE_BOUNDARY for Python, whose \s is Unicode's

    def complete(prompts: list[str], max_new_tokens: int) -> list[str]:
        abstracts = [t.split(fx.USER_PROMPT_BEFORE, 1)[1].rsplit(fx.USER_PROMPT_AFTER, 1)[0] for t in prompts]
        return ["Here's the TL;DR:\n" + boundary.split(a.strip(), maxsplit=1)[0] for a in abstracts]

    return complete


def predict_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = inputs.prepared(spark, sf_dir).select("split", "id", "abstract", "summary")
    return p.generate(records, _first_sentence_model).drop("abstract")


def attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records joined with the predictions of a run that were written before."""
    records = inputs.stored_records(spark, sf_dir)
    predictions = materialize(p.extractive(records).select("split", "id", "prediction"))
    return p.attach_predictions(records.select("split", "id", "summary"), predictions)


# --- sources and sinks: written to the shared folder and read back -----------------


def papers_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested papers as JSON lines, one folder per split."""
    folder = new_folder(spark)
    inputs.raw_papers(spark, sf_dir).select("split", "source", "target").write.partitionBy("split").json(folder)
    papers = record_io.read_papers(spark, folder)
    return papers.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("source")).alias("sentences"), F.sum(F.size("target")).alias("summaries")
    )


def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    record_io.write_records(inputs.prepared(spark, sf_dir), folder, "json")
    return record_io.read_records(spark, folder, "json")


def predictions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    run_io.write_predictions(p.extractive(inputs.prepared(spark, sf_dir)), folder, "first sentence")
    return run_io.read_predictions(spark, folder)


def metrics_by_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each run and split, whose name says which it is; the few metrics rows are written one by one."""
    folder, metrics = new_folder(spark), _stored_metrics(spark, sf_dir)
    run_io.write_metrics(metrics, f"{folder}/by-run")
    stored_metrics = run_io.read_metrics(spark, f"{folder}/by-run").drop("bertscore_f1")
    for name in [label for label, *_ in RUN_FACTORS]:
        for split in ("train", "val", "test"):
            one = stored_metrics.filter((F.col("name") == name) & (F.col("split") == split)).drop("name", "split")
            one.coalesce(1).write.json(f"{folder}/files/{name}__{split}.metrics.json")
    found = [run_io.read_metrics_files(spark, f"{folder}/files", split) for split in ("train", "val", "test")]
    return _rounded(found[0].unionByName(found[1]).unionByName(found[2]).drop("bertscore_f1"))


def logged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history as a tracker exports it, under its own column names."""
    folder = new_folder(spark)
    names = {"step": "_step", "train_loss": "train/loss", "eval_loss": "eval/loss", "learning_rate": "train/learning_rate"}
    inputs.history(spark, sf_dir).withColumnsRenamed(names).write.parquet(folder)
    return h.canonical_history(run_io.read_history(spark, folder))


def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark)
    corpus_profile(inputs.stored_records(spark, sf_dir), folder)
    report = spark.read.json(folder)
    shown = F.array_join(F.transform("examples", lambda x: F.concat_ws(" => ", x["abstract"], x["summary"])), "\n")
    return _rounded(report.select(
        "split", "size", F.col("abstract_tokens.median").alias("abstract_median"), F.col("summary_tokens.p95").alias("summary_p95"),
        F.col("compression_ratio.mean").alias("ratio_mean"), shown.alias("examples"),
    ))


def tokenizer_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids from a tokenizer made once for each task: here a word's id is its length."""
    texts = inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ids = tok.tokenizer_udf(lambda: lambda text: [len(word) for word in text.split(" ")])(F.col("text"))
    return texts.select("conv_id", "turn", ids.alias("input_ids")).select("conv_id", "turn", _joined("input_ids"))


def logged_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of two trackers in one folder: every other run has names of its own."""
    folder = new_folder(spark)
    rows, odd = inputs.history(spark, sf_dir), F.col("run_id").cast("long") % 2 == 1
    first = {"step": "_step", "train_loss": "train/loss", "eval_loss": "eval/loss", "learning_rate": "train/learning_rate"}
    rows.filter(~odd).withColumnsRenamed(first).write.parquet(f"{folder}/tracker=a")
    second = rows.filter(odd).withColumnsRenamed({"step": "global_step", "train_loss": "loss"})
    second.write.parquet(f"{folder}/tracker=b")
    return h.canonical_history(run_io.read_history(spark, folder))


def metric_log_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics logged under two commits, one of them twice, as after a rerun."""
    folder, metrics = new_folder(spark), _stored_metrics(spark, sf_dir)
    run_io.append_metric_log(metrics.withColumn("rouge1", F.lit(0.0)), folder, "second")
    for commit in ("first", "second"):
        run_io.append_metric_log(metrics, folder, commit)
    return _rounded(run_io.read_metric_log(spark, folder))


def split_sizes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size manifest, written twice and read back."""
    folder = new_folder(spark)
    records = inputs.stored_records(spark, sf_dir)
    for _ in range(2):
        record_io.write_split_sizes(records, folder)
    return record_io.read_split_sizes(spark, folder)


def predictions_by_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of predictions in a folder for each run and split, whose name says which it is."""
    folder, runs = new_folder(spark), materialize(inputs.runs(spark, sf_dir))
    for name in [label for label, *_ in RUN_FACTORS]:
        for split in ("train", "val", "test"):
            one = runs.filter((F.col("name") == name) & (F.col("split") == split)).select("id", "summary", "prediction")
            one.write.json(f"{folder}/{name}__{split}.jsonl")
    found = [run_io.read_prediction_files(spark, folder, split) for split in ("train", "val", "test")]
    return _rounded(res.mean_output_words(found[0].unionByName(found[1]).unionByName(found[2])))


def attach_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and predictions written in buckets of their keys, checked and joined in one pass without a shuffle."""
    folder, buckets = new_folder(spark), spark.sparkContext.defaultParallelism
    name = "t" + folder.rsplit("-", 1)[-1]
    records = run_io.write_bucketed(
        inputs.prepared(spark, sf_dir).select("split", "id", "abstract", "summary"), f"{name}_records", f"{folder}/records", buckets=buckets
    )
    made = p.extractive(records).select("split", "id", "prediction")
    predictions = run_io.write_bucketed(made, f"{name}_predictions", f"{folder}/predictions", buckets=buckets)
    return p.attach_bucketed(records.select("split", "id", "summary"), predictions)


def predict_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions in committed chunks, of which a first run made those of the validation split only."""
    records = inputs.stored_records(spark, sf_dir)
    folder = new_folder(spark)
    p.generate_resumable(records.filter("split = 'val'"), _first_sentence_model, folder, "resumed", chunks=3)
    return p.generate_resumable(records, _first_sentence_model, folder, "resumed", chunks=3)


# --- scores ---------------------------------------------------------------------


def rouge_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ROUGE-1 of each document's first sentence against the whole document."""
    documents = inputs.documents(spark, sf_dir).withColumn("prediction", text.first_sentence(F.col("text")))
    scored = m.score_pairs(documents, "prediction", "text", stem=False, metrics=["rouge1"])
    return _rounded(m.corpus_scores(scored, ["lang"], ["rouge1"]))


def _pair_scores(metric: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = m.score_pairs(inputs.pairs(spark, sf_dir), stem=False, metrics=[metric], details=True)
        return scored.drop("prediction", "reference")

    return query


def rouge_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.score_pairs(inputs.pairs(spark, sf_dir)).drop("prediction", "reference")


def _scored_runs(spark: SparkSession, sf_dir: str, stem: bool = False) -> DataFrame:
    return m.score_pairs(inputs.runs(spark, sf_dir), "prediction", "summary", stem)


def _run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.corpus_scores(_scored_runs(spark, sf_dir))


def _stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all runs as a written table, as result tables find them."""
    return materialize(_run_metrics(spark, sf_dir))


def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run_metrics(spark, sf_dir))


def corpus_scores_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.corpus_scores(_scored_runs(spark, sf_dir, stem=True)))


def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that no assistant turn follows, and assistant turns without a question."""
    turns = inputs.table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn")
    answered = turns.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return m.mismatched_keys(answered, asked, ["conv_id", "turn"])


def embedding_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = inputs.pairs(spark, sf_dir)
    vectors = inputs.token_vectors(spark, sf_dir, pairs, "reference", "prediction")
    return _rounded(m.embedding_f1(pairs, vectors, ["conv_id", "turn"]))


def embedding_f1_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for vector tables too large to broadcast."""
    pairs = inputs.pairs(spark, sf_dir)
    vectors = inputs.token_vectors(spark, sf_dir, pairs, "reference", "prediction")
    return _rounded(m.embedding_f1(pairs, vectors, ["conv_id", "turn"], broadcast_bytes=-1))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.bootstrap_interval(_scored_runs(spark, sf_dir)))


# --- profile --------------------------------------------------------------------


def _length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(prof.length_counts(prof.text_lengths(inputs.prepared(spark, sf_dir))))


def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(prof.length_profile(_length_counts(spark, sf_dir)))


def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(prof.ratio_counts(prof.text_lengths(inputs.prepared(spark, sf_dir))))
    return _rounded(prof.compression_ratio(counts))


def sketched_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from sketches of four batches, merged: whether each is within 2 % of the records of its exact rank."""
    records = inputs.prepared(spark, sf_dir).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(4)))
    lengths = materialize(prof.text_lengths(records, extra=["batch"]))
    states = materialize(prof.length_sketches(lengths, ["split", "batch"]))
    found = prof.sketch_quantiles(prof.merge_sketches(states))
    wide = lengths.withColumn("compression_ratio", F.col("summary_tokens") / F.greatest(F.col("abstract_tokens"), F.lit(1)))
    values = wide.select("split", *[F.col(c).cast("double").alias(c) for c in ("abstract_tokens", "summary_tokens", "compression_ratio")])
    exact = values.unpivot("split", ["abstract_tokens", "summary_tokens", "compression_ratio"], "measure", "x")
    counted = exact.groupBy("split", "measure", "x").agg(F.count(F.lit(1)).alias("rows"))
    ranks = found.join(counted, ["split", "measure"]).groupBy("split", "measure", "probability", "n").agg(
        F.sum(F.when(F.col("x") < F.col("value"), F.col("rows")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("x") <= F.col("value"), F.col("rows")).otherwise(0)).alias("upto"),
    )
    rank, slack = F.col("probability") * F.col("n"), F.greatest(0.02 * F.col("n"), F.lit(1.0))
    return ranks.select("split", "measure", "probability", "n", ((F.col("below") - slack <= rank) & (rank <= F.col("upto") + slack)).alias("within"))


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _length_counts(spark, sf_dir)
    both = [
        prof.histogram(counts.filter(F.col("measure") == measure), bins, ["split", "measure"])
        for measure, bins in (("abstract_tokens", fx.ABSTRACT_BINS), ("summary_tokens", fx.SUMMARY_BINS))
    ]
    return _rounded(both[0].unionByName(both[1]))


# --- training examples ----------------------------------------------------------


def _rendered(records: DataFrame) -> DataFrame:
    return records.select("split", "id", chat.render_example(F.col("abstract"), F.col("summary")).alias("text"))


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.vocabulary(_rendered(inputs.prepared(spark, sf_dir)), "text")


def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = _rendered(inputs.stored_records(spark, sf_dir))
    words = tok.vocabulary(rendered, "text")
    return tok.encode(rendered, "text", words, ["split", "id"]).select("split", "id", _joined("input_ids"))


def encode_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for vocabularies too large to broadcast."""
    rendered = _rendered(inputs.stored_records(spark, sf_dir))
    words = tok.vocabulary(rendered, "text")
    encoded = tok.encode(rendered, "text", words, ["split", "id"], broadcast_bytes=-1)
    return encoded.select("split", "id", _joined("input_ids"))


def completion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = inputs.stored_records(spark, sf_dir)
    words = tok.vocabulary(_rendered(records), "text")
    examples = tok.training_examples(records, words, max_length=fx.TRAINING_MAX_LENGTH)
    return examples.select(
        "split", "id", "prompt_length", _joined("input_ids"), _joined("attention_mask"), _joined("labels")
    )


def pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = training_batches(inputs.stored_records(spark, sf_dir))
    return batches.select(
        "split", "id", "position", "batch_id", _joined("input_ids"), _joined("attention_mask"), _joined("labels")
    )


TOKEN_BUDGET = fx.BATCH_SIZE * fx.TRAINING_MAX_LENGTH


def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training batches bounded by padded tokens: each example's batch, tokens and padded length."""
    batches = training_batches(inputs.stored_records(spark, sf_dir), token_budget=TOKEN_BUDGET)
    tokens = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda total, one: total + one)
    return batches.select(
        "split", "id", "position", "batch_id", tokens.alias("tokens"), F.size("input_ids").cast("bigint").alias("padded"),
        F.size("labels").cast("bigint").alias("labels"),
    )


def padding_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding of whole words in batches of rows and in batches of a token budget."""
    texts = _rendered(inputs.stored_records(spark, sf_dir))
    words = F.least(text.word_count(F.col("text")), F.lit(fx.TRAINING_MAX_LENGTH))
    numbered = materialize(o.number_shuffled(texts.select("split", "id", words.alias("n"))))
    kinds = {"rows": o.assign_batches(numbered, fx.BATCH_SIZE), "tokens": o.assign_token_batches(numbered, TOKEN_BUDGET, "n")}
    both = [o.padding_share(batched, "n").withColumn("kind", F.lit(kind)) for kind, batched in kinds.items()]
    return both[0].unionByName(both[1])


def tokenizer_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents from a tokenizer of lists of texts: here a line's id is its length, beyond 32 bits."""
    texts = inputs.documents(spark, sf_dir).select("doc_id", "text")
    lengths = tok.batch_tokenizer_udf(lambda: lambda batch: [[(1 << 40) + len(line) for line in x.split("\n")] for x in batch], rows=64)
    return texts.select("doc_id", lengths(F.col("text")).alias("input_ids")).select("doc_id", _joined("input_ids"))


def pad_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-padded prompts in file order, as a generator reads them."""
    records = inputs.stored_records(spark, sf_dir)
    prompts = records.select("split", "id", "pos", chat.render_example(F.col("abstract")).alias("text"))
    words = tok.vocabulary(prompts, "text")

    def place(rows: DataFrame, length: Column) -> DataFrame:
        return tok.with_longest(o.assign_batches(o.rank_rows(rows, [F.col("pos")], by=["split"]), fx.BATCH_SIZE), length)

    encoded = tok.encode(prompts, "text", words, ["split", "id", "pos"], fx.PROMPT_MAX_LENGTH, place=place)
    padded = tok.pad_batches(encoded, tok.PAD_ID, left=True, longest="longest")
    return padded.select("split", "id", "batch_id", _joined("input_ids"), _joined("attention_mask"))


# --- results --------------------------------------------------------------------


def mean_output_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(res.mean_output_words(inputs.runs(spark, sf_dir)))


def results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = materialize(inputs.runs(spark, sf_dir))
    metrics = materialize(m.corpus_scores(m.score_pairs(predictions, "prediction", "summary", stem=False)))
    display = res.display_dimension(spark, RUN_LABELS, {})
    return run_results(metrics, predictions, display).drop("bertscore_f1")


def _results_with_old_run(spark: SparkSession, sf_dir: str, include_deprecated: bool) -> DataFrame:
    """All scores, the embedding score among them, with one run listed, one deprecated and one unlisted."""
    predictions = materialize(inputs.runs(spark, sf_dir))
    vectors = inputs.token_vectors(spark, sf_dir, predictions, "prediction", "summary")
    matched = m.embedding_f1(predictions, vectors, ["name", "split", "id"], "prediction", "summary")
    scored = m.score_pairs(predictions, "prediction", "summary", stem=False).join(matched, ["name", "split", "id"])
    metrics = materialize(m.corpus_scores(scored, metrics=[*m.ROUGE, "bertscore_f1"]))
    display = res.display_dimension(spark, {"qlora_last_sentence": "Last sentence"}, {"lead_20_words": "Lead (deprecated)"})
    return run_results(metrics, predictions, display, include_deprecated)


def results_with_deprecated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results_with_old_run(spark, sf_dir, True)


def results_without_deprecated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results_with_old_run(spark, sf_dir, False)


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(res.gains_over(_stored_metrics(spark, sf_dir), "extractive_first_sentence", m.ROUGE))


def dev_test_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(res.split_gap(_run_metrics(spark, sf_dir), scores=m.ROUGE))


def ablation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 by split, model and rank, one column for each variant, and what the second variant gains."""
    factors = spark.createDataFrame(RUN_FACTORS, "name string, variant string, model string, rank int")
    metrics = res.with_factors(_run_metrics(spark, sf_dir), factors)
    table = res.ablation_table(metrics, ["split", "model", "rank"], "variant", ["sentence", "words"])
    return _rounded(res.variant_deltas(table, "sentence", "words"))


def rank_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean output words by the model and adapter rank a run had when it was logged, with its trainable numbers.

    The run dimension is a written table; one run changes its rank on the third of four days.
    """
    days = [("2024-01-01", "2024-01-03"), ("2024-01-03", None)]
    versions = [(*RUN_FACTORS[0][:3], 0, *days[0]), (*RUN_FACTORS[1][:3], 0, None, None), (*RUN_FACTORS[2][:3], 16, *days[0]), (*RUN_FACTORS[2], *days[1])]
    listed = spark.createDataFrame(versions, "name string, variant string, model string, rank int, valid_from string, valid_to string")
    folder = new_folder(spark)
    run_io.write_run_factors(listed.withColumn("trainable_params", res.adapter_parameters(F.col("rank"), ADAPTED, LAYERS)), folder)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.conv(F.substring("id", 1, 1), 16, 10).cast("int") % 4)
    logged = res.mean_output_words(inputs.runs(spark, sf_dir).withColumn("logged_at", day), ["name", "split", "logged_at"])
    known = res.factors_at(logged, run_io.read_run_factors(spark, folder))
    return _rounded(known.groupBy("split", "name", "model", "variant", "rank", "trainable_params").agg(
        F.count("*").alias("days"), F.max("words").alias("words")
    ))


def metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(res.metric_log(_run_metrics(spark, sf_dir)))


# --- run history ----------------------------------------------------------------


def loss_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.in_step_order(h.sparse_series(inputs.history(spark, sf_dir)))


def logged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.every_steps(inputs.history(spark, sf_dir), fx.LOG_EVERY_STEPS)


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.best_checkpoint(inputs.history(spark, sf_dir))


def retained_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.retained_checkpoints(inputs.history(spark, sf_dir))


def all_queries() -> dict[str, Query]:
    named = [
        prepare_records, dedupe_first, split_manifest, shuffle_order, shuffle_sample, head_subset,
        first_sentence, strip_preamble, render_chat, predict_batched, attach_predictions,
        rouge_by_language, rouge_stemmed, corpus_scores, corpus_scores_stemmed, alignment_check,
        embedding_f1, embedding_f1_shuffled, bootstrap_ci,
        length_profile, compression_ratio, length_histogram,
        vocab, encode, encode_shuffled, completion_mask, pad_batches, token_batches, padding_share, pad_prompts,
        papers_scan, records_round_trip, predictions_round_trip, metrics_by_file_name, logged_history, profile_report,
        logged_histories, metric_log_again, split_sizes_file, predictions_by_file_name, attach_bucketed, predict_resumed, sketched_profile,
        tokenizer_factory, tokenizer_batched, rank_ablation, mean_output_words, results_table, results_with_deprecated, results_without_deprecated, run_comparison, dev_test_gap, ablation_table, metric_long,
        loss_curves, logged_steps, best_checkpoint, retained_checkpoints,
    ]
    queries = {query.__name__: query for query in named}
    queries |= {"rouge1": _pair_scores("rouge1"), "rouge2": _pair_scores("rouge2"), "rouge_l": _pair_scores("rougeL")}
    return queries
