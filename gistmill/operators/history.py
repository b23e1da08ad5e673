"""Run histories: sparse metric series, best and retained checkpoints."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill import fixed_values as fx
from gistmill.operators import lookup
from gistmill.session import materialize

SERIES = ("train_loss", "eval_loss", "learning_rate")


def first_existing(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((name for name in candidates if name in columns), None)


def canonical_history(
    history: DataFrame, candidates: Mapping[str, Sequence[str]] = fx.HISTORY_COLUMNS, strict: bool = False
) -> DataFrame:
    """Rename logged columns to ``step`` and the series names, for each run by itself.

    Of a series' candidates a run (``run_id``; without that column the whole table is one) uses the first that it has a value of; its
    values of others are not mixed in. Step and train loss must exist as columns, and every run must have a
    step; with ``strict`` also a train loss. A series for which no column exists is left out. Rows without a run id take the first value they have.

    Runs are reduced to one row each before they meet their rows; that table is broadcast only if it was measured to be small.
    """
    found = {name: [c for c in options if c in history.columns] for name, options in candidates.items()}
    for required in ("step", "train_loss"):
        if not found[required]:
            raise ValueError(f"could not find a {required} column in {history.columns}")
    found = {name: columns for name, columns in found.items() if columns}
    ids = ["run_id"] if "run_id" in history.columns else []
    run = F.col("run_id") if ids else F.lit("")
    rows = history.select(run.alias("run_id"), *[
        F.col(f"`{column}`").alias(f"_{name}{place}") for name, columns in found.items() for place, column in enumerate(columns)
    ])
    def first_logged(name: str) -> Column:
        return F.coalesce(*[F.when(F.count(f"_{name}{place}") > 0, F.lit(place)) for place in range(len(found[name]))]).alias(f"_{name}")

    # a column that is the only candidate needs no choice; whether a run has the required ones is asked all the same
    asked = [name for name, columns in found.items() if len(columns) > 1 or name == "step" or (strict and name == "train_loss")]
    chosen = materialize(rows.groupBy("run_id").agg(*[first_logged(name) for name in asked]))
    small = lookup.fits_broadcast(chosen, F.octet_length(F.col("run_id").cast("string")) + 8 * len(asked))
    rows = (lookup.broadcast_lookup if small else lookup.frequent_lookup)(rows, chosen, "run_id")

    def value(name: str) -> Column:
        options = [F.col(f"_{name}{place}") for place in range(len(found[name]))]
        known = F.coalesce(*options)
        if name not in asked:
            return known.alias(name)
        picked = F.coalesce(*[F.when(F.col(f"_{name}") == place, option) for place, option in enumerate(options)])
        if name == "step" or strict and name == "train_loss":
            missing = F.raise_error(F.concat(F.lit(f"no {name} logged by run "), F.col("run_id")))
            picked = F.when(F.col(f"_{name}").isNull() & F.col("run_id").isNotNull(), missing.cast("double")).otherwise(picked)
        return F.when(F.col("run_id").isNull(), known).otherwise(picked).cast(_common_type(rows, options)).alias(name)

    return rows.select(*ids, *[value(name) for name in found])


def _common_type(rows: DataFrame, options: Sequence[Column]) -> T.DataType:
    return rows.select(F.coalesce(*options)).schema[0].dataType


def sparse_series(history: DataFrame, ids: Sequence[str] = ("run_id",)) -> DataFrame:
    """``(run, series, step, value)`` for every logged value."""
    logged = [name for name in SERIES if name in history.columns]
    long = history.unpivot([*ids, "step"], logged, "series", "value")
    return long.filter(F.col("value").isNotNull() & F.col("step").isNotNull()).select(*ids, "series", "step", "value")


def in_step_order(series: DataFrame, ids: Sequence[str] = ("run_id",)) -> DataFrame:
    return series.orderBy(*ids, "series", "step")


def every_steps(history: DataFrame, interval: int) -> DataFrame:
    """Rows on the logging, evaluation or saving grid."""
    return history.filter(F.pmod(F.col("step"), F.lit(interval)) == 0)


def best_checkpoint(history: DataFrame, ids: Sequence[str] = ("run_id",)) -> DataFrame:
    """``(run, step, eval_loss)`` of the lowest evaluation loss; the earliest step wins a tie."""
    evaluated = history.filter(F.col("eval_loss").isNotNull())
    best = evaluated.groupBy(*ids).agg(F.min(F.struct("eval_loss", "step")).alias("best"))
    return best.select(*ids, F.col("best.step").alias("step"), F.col("best.eval_loss").alias("eval_loss"))


def newest_checkpoints(saved: DataFrame, keep: int, ids: Sequence[str] = ("run_id",)) -> DataFrame:
    """The ``keep`` latest steps of each run (Spark applies the limit before the shuffle)."""
    newest = Window.partitionBy(*ids).orderBy(F.col("step").desc())
    ranked = saved.select(*ids, "step").withColumn("age", F.row_number().over(newest))
    return ranked.filter(F.col("age") <= keep)


def retained_checkpoints(
    history: DataFrame,
    save_every: int = fx.SAVE_EVERY_STEPS,
    keep: int = fx.CHECKPOINTS_KEPT,
    ids: Sequence[str] = ("run_id",),
) -> DataFrame:
    """``(run, step, is_best)``: ``keep`` saved steps per run, the best evaluated one among them.

    The best checkpoint takes the place of the oldest that would be kept. With
    ``keep=1`` the latest stays as well, so that a run can be resumed.
    """
    saved = every_steps(history, save_every)
    best = best_checkpoint(saved, ids).select(*ids, "step", F.lit(0).alias("age"), F.lit(True).alias("is_best"))
    newest = newest_checkpoints(saved, keep, ids).withColumn("is_best", F.lit(False))
    candidates = newest.unionByName(best).groupBy(*ids, "step").agg(
        F.max("age").alias("age"), F.max("is_best").alias("is_best")
    )
    priority = Window.partitionBy(*ids).orderBy((F.col("age") == 1).desc(), F.col("is_best").desc(), F.col("step").desc())
    room = F.when(F.max("is_best").over(Window.partitionBy(*ids)), F.lit(max(keep, 2))).otherwise(F.lit(keep))
    ranked = candidates.withColumns({"_place": F.row_number().over(priority), "_room": room})
    kept = F.col("_place") <= F.col("_room")
    if keep == 1:
        kept = kept & ((F.col("age") == 1) | F.col("is_best"))
    return ranked.filter(kept).select(*ids, "step", "is_best")
