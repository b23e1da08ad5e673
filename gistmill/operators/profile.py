"""Length distributions, compression ratios, histograms and examples.

The corpus is read once and reduced to counts of distinct values; all
statistics come from that small table.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill import fixed_values as fx
from gistmill.functions.text import ellipsize, word_count
from gistmill.operators.ordering import sample_rows, shuffle_key
from gistmill.session import materialize


def text_lengths(records: DataFrame, length: Callable[[Column], Column] = word_count, extra: Sequence[str] = ()) -> DataFrame:
    return records.select(
        "split", *extra, length(F.col("abstract")).alias("abstract_tokens"), length(F.col("summary")).alias("summary_tokens")
    )


def length_counts(lengths: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """``(by, measure, value, n)`` for both lengths of every record; a missing text has no length."""
    measures = ("abstract_tokens", "summary_tokens")
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("bigint").alias("value")) for m in measures])
    known = lengths.select(*by, F.inline(rows)).filter(F.col("value").isNotNull())
    return known.groupBy(*by, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def ratio_counts(lengths: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """``(by, value, n)`` of summary length over abstract length, at least 1 below, where both are known."""
    ratio = F.col("summary_tokens") / F.greatest(F.col("abstract_tokens"), F.lit(1))
    known = lengths.filter(F.col("summary_tokens").isNotNull() & F.col("abstract_tokens").isNotNull())
    return known.select(*by, ratio.alias("value")).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def weighted_percentiles(
    counts: DataFrame, by: Sequence[str], probabilities: Sequence[float], buckets_per_unit: float = 1.0
) -> DataFrame:
    """``(by, probability, value)``: exact, linearly interpolated percentiles.

    Buckets of values are counted and accumulated first; only values in the
    buckets that hold a wanted rank are then ordered. No task sees a whole group,
    and hot values are already counts.
    """
    bucketed = counts.withColumn("_bucket", F.floor(F.col("value") * buckets_per_unit))
    sizes = bucketed.groupBy(*by, "_bucket").agg(F.sum("n").alias("_size"))
    upto = Window.partitionBy(*by).orderBy("_bucket")
    placed = sizes.select(
        *by,
        "_bucket",
        (F.sum("_size").over(upto) - F.col("_size")).alias("_before"),
        "_size",
        F.sum("_size").over(Window.partitionBy(*by)).alias("_total"),
    )
    rank = F.col("probability") * (F.col("_total") - 1)
    wanted = (
        placed.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumns({"_low": F.floor(rank), "_high": F.ceil(rank), "_part": rank - F.floor(rank)})
        .filter((F.col("_high") >= F.col("_before")) & (F.col("_low") < F.col("_before") + F.col("_size")))
        .drop("_size", "_total")
    )
    inside = Window.partitionBy(*by, "probability", "_bucket").orderBy("value")
    ordered = bucketed.join(wanted, [*by, "_bucket"]).withColumn(
        "_upto", F.col("_before") + F.sum("n").over(inside)
    )

    def at(position: str) -> Column:
        covers = (F.col(position) < F.col("_upto")) & (F.col(position) >= F.col("_upto") - F.col("n"))
        return F.max(F.when(covers, F.col("value")))

    found = ordered.groupBy(*by, "probability").agg(
        at("_low").alias("_a"), at("_high").alias("_b"), F.max("_part").alias("_part")
    )
    return found.select(
        *by, "probability", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("value")
    )


def length_profile(counts: DataFrame, by: Sequence[str] = ("split", "measure")) -> DataFrame:
    """``(by, n, mean, median, p5, p95, max)`` from :func:`length_counts`."""
    p5, median, p95 = fx.PROFILE_PERCENTILES
    wide = (
        weighted_percentiles(counts, by, fx.PROFILE_PERCENTILES)
        .groupBy(*by)
        .agg(*[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)
            for name, p in (("median", median), ("p5", p5), ("p95", p95))
        ])
    )
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max("value").alias("max"),
    )
    return totals.join(wide, list(by)).select(*by, "n", "mean", "median", "p5", "p95", "max")


def compression_ratio(counts: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """``(by, mean, median)`` from :func:`ratio_counts`."""
    median = weighted_percentiles(counts, by, [0.5], buckets_per_unit=4096).select(
        *by, F.col("value").alias("median")
    )
    means = counts.groupBy(*by).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    return means.join(median, list(by)).select(*by, "mean", "median")


def histogram(counts: DataFrame, bins: int, by: Sequence[str] = ("split",)) -> DataFrame:
    """``(by, bin, low, high, n)``: equal-width bins over each group's range, the last one closed.

    Empty bins are kept. A group with a single value spans half a unit to either side.
    """
    ranges = counts.groupBy(*by).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    span = F.col("_max") - F.col("_min")
    bin_of = F.when(span == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_min")) * bins / F.greatest(span, F.lit(1))), F.lit(bins - 1))
    )
    filled = (
        counts.join(ranges, list(by)).withColumn("bin", bin_of.cast("int")).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    )
    low = F.when(span == 0, F.col("_min") - 0.5).otherwise(F.col("_min").cast("double"))
    width = F.when(span == 0, F.lit(1.0)).otherwise(span.cast("double")) / bins
    every = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *by, "bin", (low + width * F.col("bin")).alias("low"), (low + width * (F.col("bin") + 1)).alias("high")
    )
    return every.join(filled, [*by, "bin"], "left").select(
        *by, "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n")
    )


def example_rows(records: DataFrame, k: int = fx.EXAMPLE_ROWS, seed: int = fx.EXAMPLE_SEED) -> DataFrame:
    """``k`` seeded examples with shortened abstracts."""
    return sample_rows(records, k, seed).select(ellipsize(F.col("abstract")).alias("abstract"), "summary")


def split_examples(records: DataFrame, k: int = fx.EXAMPLE_ROWS, seed: int = fx.EXAMPLE_SEED) -> DataFrame:
    """``(split, examples)``: up to ``k`` seeded examples of every split (the limit comes before the shuffle)."""
    place = F.row_number().over(Window.partitionBy("split").orderBy(shuffle_key(seed, "id"), "id"))
    picked = records.select("split", "id", "abstract", "summary").withColumn("_place", place).filter(F.col("_place") <= k)
    example = F.struct("_place", ellipsize(F.col("abstract")).alias("abstract"), "summary")
    ordered = F.sort_array(F.collect_list(example))
    return picked.groupBy("split").agg(
        F.transform(ordered, lambda x: F.struct(x["abstract"].alias("abstract"), x["summary"].alias("summary"))).alias("examples")
    )


def profile_report(records: DataFrame, length: Callable[[Column], Column] = word_count) -> DataFrame:
    """One row per split: size, both length profiles, compression ratio, and seeded examples.

    A split of fewer than ``fx.EXAMPLE_ROWS`` records shows all of them.
    """
    lengths = materialize(text_lengths(records, length))
    profile = length_profile(length_counts(lengths))
    stats = F.struct("n", "mean", "median", "p5", "p95", "max")
    sizes = records.groupBy("split").agg(F.count(F.lit(1)).alias("size"))
    wide = profile.groupBy("split").agg(
        *[
            F.max(F.when(F.col("measure") == m, stats)).alias(m)
            for m in ("abstract_tokens", "summary_tokens")
        ],
    )
    ratio = compression_ratio(ratio_counts(lengths)).select(
        "split", F.struct("mean", "median").alias("compression_ratio")
    )
    return sizes.join(wide, "split", "left").join(ratio, "split", "left").join(split_examples(records), "split", "left")


def length_sketches(lengths: DataFrame, by: Sequence[str] = ("split",), k: int = 400) -> DataFrame:
    """``(by, measure, state)``: a mergeable quantile sketch (KLL) of each length, and of the compression ratio.

    The approximate form of :func:`length_profile` and :func:`compression_ratio`: a state has a few kilobytes however many
    records it covers. States of batches, splits or days are kept as a table and merged by :func:`merge_sketches`.
    """
    sketched = {name: F.kll_sketch_agg_double(F.col(name).cast("double"), F.lit(k)) for name in ("abstract_tokens", "summary_tokens")}
    ratio = F.when(F.col("abstract_tokens").isNotNull(), F.col("summary_tokens") / F.greatest(F.col("abstract_tokens"), F.lit(1)))
    sketched["compression_ratio"] = F.kll_sketch_agg_double(ratio, F.lit(k))
    states = lengths.groupBy(*by).agg(*[state.alias(name) for name, state in sketched.items()])
    return states.unpivot(list(by), list(sketched), "measure", "state")


def merge_sketches(states: DataFrame, by: Sequence[str] = ("split", "measure")) -> DataFrame:
    """One state for each group of states: what one pass over all their records would hold, within the same error."""
    return states.groupBy(*by).agg(F.kll_merge_agg_double("state").alias("state"))


def sketch_quantiles(states: DataFrame, by: Sequence[str] = ("split", "measure"), probabilities: Sequence[float] = fx.PROFILE_PERCENTILES) -> DataFrame:
    """``(by, n, probability, value)``: approximate percentiles; at ``k`` = 400 a value's rank is off by about 0.7 % of the records."""
    wanted = [
        F.struct(F.lit(float(p)).alias("probability"), F.kll_sketch_get_quantile_double("state", F.lit(float(p))).alias("value")) for p in probabilities
    ]
    return states.select(*by, F.kll_sketch_get_n_double("state").alias("n"), F.inline(F.array(*wanted)))
