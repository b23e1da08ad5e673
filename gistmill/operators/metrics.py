"""Scores of predictions against references, per pair and per corpus."""

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill.functions import rouge, softmatch
from gistmill.functions.stem import stem_words
from gistmill.operators import lookup
from gistmill.session import compute_once, materialize

ROUGE = ("rouge1", "rouge2", "rougeL")


def mismatched_keys(
    predictions: DataFrame, references: DataFrame, keys: Sequence[str] = ("split", "id"), once: bool = False
) -> DataFrame:
    """Keys that do not occur equally often on both sides (or, with ``once``, exactly once on each).

    Counting a union reduces repeated keys before the shuffle, where an outer
    join would bring all copies of a key to one task.
    """
    tagged = predictions.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        references.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("r"))
    )
    counted = tagged.groupBy(*keys).agg(F.sum("p").alias("n_predictions"), F.sum("r").alias("n_references"))
    differ = F.col("n_predictions") != F.col("n_references")
    return counted.filter(differ | (F.col("n_references") > 1) if once else differ)


def check_aligned(
    predictions: DataFrame, references: DataFrame, keys: Sequence[str] = ("split", "id"), once: bool = False
) -> None:
    row = (
        mismatched_keys(predictions, references, keys, once)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_predictions").alias("p"), F.sum("n_references").alias("r"))
        .first()
    )
    if row["n"]:
        raise ValueError(f"length mismatch: {row['n']} keys differ ({row['p']} preds vs {row['r']} refs)")


def rouge_counts(
    df: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    stem: bool = True,
    metrics: Sequence[str] = ROUGE,
) -> DataFrame:
    """Add the integer counts behind each metric: hits, and units on either side.

    Both texts sit in one row, so this is a narrow step: no explode, no shuffle.
    """
    words = compute_once(
        df, _pred=rouge.rouge_words(F.col(prediction)), _ref=rouge.rouge_words(F.col(reference))
    )
    if stem and "rougeL" in metrics:
        both = words.withColumn("_both", rouge.stemmed_pair("_pred", "_ref"))
        words = both.withColumns({"_pred": F.col("_both.pred"), "_ref": F.col("_both.ref"), "rougeL_hits": F.col("_both.lcs")}).drop("_both")
    elif stem:
        words = words.withColumns({"_pred": stem_words("_pred"), "_ref": stem_words("_ref")})
    elif "rougeL" in metrics:
        words = words.withColumn("rougeL_hits", rouge.lcs_length("_pred", "_ref"))
    tokens = compute_once(
        words, _p=rouge.word_array(F.col("_pred")), _r=rouge.word_array(F.col("_ref"))
    ).drop("_pred", "_ref")
    counts = {"n_pred": F.size("_p"), "n_ref": F.size("_r")}
    for name, n in (("rouge1", 1), ("rouge2", 2)):
        if name in metrics:
            # bound once: the overlap names each array several times
            grams = {f"_p{n}": rouge.ngrams(F.col("_p"), n), f"_r{n}": rouge.ngrams(F.col("_r"), n)}
            tokens = compute_once(tokens, **grams) if n > 1 else tokens.withColumns(grams)
            counts[f"{name}_hits"] = rouge.multiset_overlap(F.col(f"_p{n}"), F.col(f"_r{n}"))
    return tokens.withColumns(counts).drop("_p", "_r", "_p1", "_r1", "_p2", "_r2")


def _units(metric: str, side: str) -> Column:
    return F.greatest(F.col(side) - 1, F.lit(0)) if metric == "rouge2" else F.col(side)


def score_pairs(
    df: DataFrame,
    prediction: str = "prediction",
    reference: str = "reference",
    stem: bool = True,
    metrics: Sequence[str] = ROUGE,
    details: bool = False,
) -> DataFrame:
    """Add the F-measure of each metric (with ``details`` also precision and recall)."""
    counted = rouge_counts(df, prediction, reference, stem, metrics)
    scores: dict[str, Column] = {}
    for name in metrics:
        hits, predicted, expected = F.col(f"{name}_hits"), _units(name, "n_pred"), _units(name, "n_ref")
        scores[name] = rouge.f_measure(hits, predicted, expected)
        if details:
            scores[f"{name}_precision"] = rouge.precision(hits, predicted)
            scores[f"{name}_recall"] = rouge.precision(hits, expected)
    return counted.withColumns(scores).drop(*[f"{m}_hits" for m in metrics], "n_pred", "n_ref")


def corpus_scores(scored: DataFrame, by: Sequence[str] = ("name", "split"), metrics: Sequence[str] = ROUGE) -> DataFrame:
    """Plain means over pairs, and the number of pairs."""
    return scored.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def embedding_f1(
    df: DataFrame,
    vectors: DataFrame,
    keys: Sequence[str],
    prediction: str = "prediction",
    reference: str = "reference",
    out: str = "bertscore_f1",
    broadcast_bytes: int = lookup.BROADCAST_BYTES,
) -> DataFrame:
    """``keys`` and the F1 of best cosine matches between the words of both texts; a row for each row of ``df``.

    ``vectors`` is ``(token, vector)``, vectors of one length. Words without a vector count as unmatched. A
    table that was measured to be small is broadcast as one matrix with a sorted array of word hashes, and pairs are scored in
    their rows, with no shuffle. Otherwise pairs are packed into written blocks; each block asks for its distinct words
    once, however many of its pairs have them, the few words that most blocks ask for are looked up by
    broadcast and the rest by a shuffle join, and a block meets its vectors once. Vectors stay single floats.
    """
    texts = df.select(*keys, rouge.rouge_words(F.col(prediction)).alias("_p"), rouge.rouge_words(F.col(reference)).alias("_r"))
    table = vectors.select("token", F.col("vector").cast("array<float>").alias("vector"))
    size = F.octet_length("token") + 24 + 4 * F.size("vector")
    if lookup.fits_broadcast(table, size, broadcast_bytes):
        return texts.select(*keys, _broadcast_match(table)("_p", "_r").alias(out))
    return _match_in_blocks(texts, table, list(keys), out)


def _broadcast_match(table: DataFrame):
    rows = table.toArrow()
    held = table.sparkSession.sparkContext.broadcast(softmatch.store(rows.column("token"), rows.column("vector")))

    @F.arrow_udf(T.DoubleType())
    def match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array(softmatch.f1(left, right, held.value), pa.float64())

    return match


def _match_in_blocks(texts: DataFrame, table: DataFrame, keys: list[str], out: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in softmatch.pieces(batches, ("_p", "_r")):
            words = softmatch.distinct_words(batch.column("_p"), batch.column("_r"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([base + number], pa.int64()), "words": pa.array([words], pa.list_(pa.string())),
                "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            })
            number += 1

    def match(blocks: pa.Table, found: pa.Table) -> pa.Table:
        with pa.ipc.open_stream(blocks.column("payload")[0].as_buffer()) as reader:
            batch = reader.read_next_batch()
        scores = softmatch.f1(batch.column("_p"), batch.column("_r"), softmatch.store(found.column("token"), found.column("vector")))
        return pa.Table.from_batches([batch]).select(keys).append_column(out, pa.array(scores, pa.float64()))

    blocks = materialize(texts.mapInArrow(pack, "block long, words array<string>, payload binary"))
    asked = blocks.select(F.col("block").alias("asker"), F.explode("words").alias("token"))
    found = lookup.frequent_lookup(asked, table, "token").filter(F.col("vector").isNotNull())
    schema = T.StructType([texts.schema[k] for k in keys] + [T.StructField(out, T.DoubleType())])
    pairs = blocks.select("block", "payload").groupBy("block")
    return pairs.cogroup(found.groupBy("asker")).applyInArrow(match, schema)


def poisson_cutoffs(digits: int = 8) -> list[str]:
    """Upper hex bounds of a uniform draw for the Poisson(1) counts 0, 1, 2, ..."""
    cutoffs, cumulative, term, k = [], 0.0, math.exp(-1), 0
    while True:
        cumulative += term
        bound = round(cumulative * 16**digits)
        if bound >= 16**digits:
            return cutoffs
        cutoffs.append(f"{bound:0{digits}x}")
        k += 1
        term /= k


def _poisson_weight(draw: Column) -> Column:
    cutoffs = poisson_cutoffs()
    weight = F.when(draw < cutoffs[0], 0)
    for count, cutoff in enumerate(cutoffs[1:], start=1):
        weight = weight.when(draw < cutoff, count)
    return weight.otherwise(len(cutoffs))


def bootstrap_interval(
    scored: DataFrame,
    by: Sequence[str] = ("name", "split"),
    metrics: Sequence[str] = ROUGE,
    key: str = "id",
    resamples: int = 1000,
    confidence: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Percentile interval of each corpus mean from a Poisson bootstrap.

    A pair's weight in a resample is drawn from a digest of its key, so results
    do not depend on how rows are partitioned. One digest gives four draws. The
    resamples of a row are summed up where the row is; only one row per group,
    resample and task is shuffled.
    """
    if resamples % 4:
        raise ValueError("resamples must be a multiple of 4")
    blocks = scored.select(
        *by, key, *metrics, F.explode(F.sequence(F.lit(0), F.lit(resamples // 4 - 1))).alias("_block")
    )
    digests = compute_once(
        blocks, _digest=F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("_block").cast("string")))
    )
    draws = [f"_w{i}" for i in range(4)]
    weighted = compute_once(
        digests, **{w: _poisson_weight(F.substring("_digest", 8 * i + 1, 8)) for i, w in enumerate(draws)}
    )
    sums = [F.sum(w).alias(f"{w}_n") for w in draws]
    sums += [F.sum(F.col(w) * F.col(m)).alias(f"{w}_{m}") for w in draws for m in metrics]
    totals = weighted.groupBy(*by, "_block").agg(*sums)
    means = F.array(*[
        F.struct(*[F.try_divide(F.col(f"{w}_{m}"), F.col(f"{w}_n")).alias(m) for m in metrics]) for w in draws
    ])
    replicates = totals.select(*by, F.inline(means))
    tail = (1 - confidence) / 2
    points = {"low": tail, "mid": 0.5, "high": 1 - tail}
    return replicates.groupBy(*by).agg(*[
        F.percentile(m, F.lit(p)).alias(f"{m}_{label}") for m in metrics for label, p in points.items()
    ])
