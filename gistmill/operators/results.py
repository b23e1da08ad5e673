"""Result tables over runs: joins with output lengths and labels, best run, comparisons."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill import fixed_values as fx
from gistmill.functions.text import word_count
from gistmill.schemas import DISPLAY

SCORES = ("rouge1", "rouge2", "rougeL", "bertscore_f1")
LISTED, DEPRECATED, UNLISTED = 0, 1, 2


def display_dimension(
    spark: SparkSession,
    labels: Mapping[str, str] = fx.DISPLAY_LABELS,
    deprecated: Mapping[str, str] = fx.DEPRECATED_LABELS,
) -> DataFrame:
    """``(name, label, ord, deprecated)`` in the order given."""
    rows = [
        (name, label, position, old)
        for old, group in ((False, labels), (True, deprecated))
        for position, (name, label) in enumerate(group.items())
    ]
    return spark.createDataFrame(rows, DISPLAY)


def mean_output_words(predictions: DataFrame, by: Sequence[str] = ("name", "split")) -> DataFrame:
    """Mean words per prediction; missing predictions do not count, empty ones do."""
    return predictions.groupBy(*by).agg(F.avg(word_count(F.col("prediction"))).alias("words"))


def best_run(listed: DataFrame, prefix: str = fx.TUNED_PREFIX, by: Sequence[str] = ("split",)) -> DataFrame:
    """``(by, best)``: highest ROUGE-1 among runs with the prefix; ties go to the first in order."""
    entrants = listed.filter(F.col("name").startswith(prefix) & (F.col("rouge1") > -1))
    return entrants.groupBy(*by).agg(F.max_by("name", F.struct("rouge1", -F.col("ord"))).alias("best"))


def results_table(
    metrics: DataFrame,
    words: DataFrame,
    display: DataFrame,
    include_deprecated: bool = False,
    prefix: str = fx.TUNED_PREFIX,
) -> DataFrame:
    """Listed runs in display order, deprecated ones on request, then all others by file name."""
    runs = metrics.join(words, ["name", "split"], "left")
    for score in SCORES:
        if score not in runs.columns:
            runs = runs.withColumn(score, F.lit(None).cast("double"))
    labelled = runs.join(display, "name")
    listed = labelled.filter(~F.col("deprecated")).withColumn("section", F.lit(LISTED))
    unlisted = runs.join(display, "name", "left_anti").select(
        "*", F.col("name").alias("label"), F.lit(None).cast("int").alias("ord"), F.lit(UNLISTED).alias("section")
    )
    sections = listed.drop("deprecated").unionByName(unlisted)
    if include_deprecated:
        old = labelled.filter("deprecated").withColumn("section", F.lit(DEPRECATED))
        sections = sections.unionByName(old.drop("deprecated"))
    is_best = (F.col("section") == LISTED) & F.col("name").eqNullSafe(F.col("best"))
    file_name = F.concat("name", F.lit("__"), "split", F.lit(".metrics.json"))
    return (
        sections.join(best_run(listed, prefix), "split", "left")
        .orderBy("split", "section", "ord", file_name)
        .select(
            "split", "section", "ord", "name", "label",
            *[F.round(score, 3).alias(score) for score in SCORES],
            F.round("words", 1).alias("words"),
            is_best.alias("is_best"),
        )
    )


def gains_over(metrics: DataFrame, baseline: str, scores: Sequence[str] = SCORES) -> DataFrame:
    """Absolute and relative gain of every run over one baseline run of the same split; null where it has none."""
    base = metrics.filter(F.col("name") == baseline).select(
        "split", *[F.col(s).alias(f"{s}_base") for s in scores]
    )
    gains = {}
    for s in scores:
        gains[f"{s}_gain"] = F.col(s) - F.col(f"{s}_base")
        gains[f"{s}_relative"] = F.try_divide(F.col(s) - F.col(f"{s}_base"), F.col(f"{s}_base"))
    return metrics.join(base, "split", "left").withColumns(gains).drop(*[f"{s}_base" for s in scores])


def split_gap(
    metrics: DataFrame, dev: str = "val", test: str = "test", scores: Sequence[str] = SCORES
) -> DataFrame:
    """``(name, <score>_dev, <score>_test, <score>_gap)``: how much a run loses from dev to test."""
    def on(split: str, score: str):
        return F.max(F.when(F.col("split") == split, F.col(score)))

    wide = metrics.groupBy("name").agg(*[
        on(split, s).alias(f"{s}_{side}") for s in scores for side, split in (("dev", dev), ("test", test))
    ])
    return wide.withColumns({f"{s}_gap": F.col(f"{s}_test") - F.col(f"{s}_dev") for s in scores})


def with_factors(metrics: DataFrame, factors: DataFrame) -> DataFrame:
    """Metrics with what each run varied: ``factors`` is ``(name, <factor>...)``, one row per run.

    Runs without a row keep their metrics, with null factors.
    """
    return metrics.join(factors, "name", "left")


def adapter_parameters(rank: Column, shapes: Sequence[tuple[int, int]], layers: int) -> Column:
    """Trainable numbers of low-rank adapters on matrices of ``shapes`` (inputs, outputs) in each of ``layers``."""
    return (rank * F.lit(layers * sum(inputs + outputs for inputs, outputs in shapes))).cast("bigint")


def factors_at(metrics: DataFrame, factors: DataFrame, at: str = "logged_at") -> DataFrame:
    """Metrics with the factors their run had on the day ``at``.

    A row of ``factors`` holds from ``valid_from`` until the day before ``valid_to``; a null is open. Metrics of days
    without a valid row keep null factors. Validities of a run that overlap are an error, as are two that start together.
    """
    start, end = F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    order = Window.partitionBy("name").orderBy("_from", "_to")
    earlier = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    wrong = F.raise_error(F.concat(F.lit("overlapping factors of run "), F.col("name"))).cast("date")
    spans = factors.withColumns({"_from": start, "_to": end})
    spans = spans.withColumn("_from", F.when(earlier > F.col("_from"), wrong).otherwise(F.col("_from")))
    held = spans.drop("valid_from", "valid_to").withColumnRenamed("name", "_run")
    valid = (F.col("name") == F.col("_run")) & (F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_to"))
    return metrics.join(held, valid, "left").drop("_run", "_from", "_to")


def ablation_table(
    metrics: DataFrame, rows: Sequence[str], variant: str, variants: Sequence[str], scores: Sequence[str] = ("rouge1",)
) -> DataFrame:
    """One line per combination of ``rows``, one column per variant and score.

    Two runs in one cell are an error, not a choice between them.
    """

    def only(score: str):
        several = F.raise_error(F.lit(f"several runs in one cell of {[*rows, variant]}")).cast("double")
        return F.when(F.count(score) > 1, several).otherwise(F.max(score)).alias(score)

    pivoted = metrics.groupBy(*rows).pivot(variant, list(variants)).agg(*[only(s) for s in scores])
    if len(scores) == 1:
        pivoted = pivoted.withColumnsRenamed({v: f"{v}_{scores[0]}" for v in variants})
    return pivoted


def variant_deltas(table: DataFrame, before: str, after: str, scores: Sequence[str] = ("rouge1",)) -> DataFrame:
    """Change of each score from one variant to another, for an :func:`ablation_table`."""
    return table.withColumns({f"{s}_delta": F.col(f"{after}_{s}") - F.col(f"{before}_{s}") for s in scores})


def metric_log(metrics: DataFrame, ids: Sequence[str] = ("name", "split")) -> DataFrame:
    """``(ids, metric, value)``: one row per numeric field."""
    numeric = [
        f.name for f in metrics.schema.fields if f.name not in ids and isinstance(f.dataType, T.NumericType)
    ]
    wide = metrics.select(*ids, *[F.col(c).cast("double").alias(c) for c in numeric])
    return wide.unpivot(list(ids), numeric, "metric", "value")
