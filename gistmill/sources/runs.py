"""Predictions, metrics, reports and histories of runs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from gistmill.operators.results import metric_log
from gistmill.schemas import METRICS, PREDICTION, RUN_FACTORS
from gistmill.sources.records import read_json_lines


def _replace_partitions(df: DataFrame, path: str, fmt: str, *partitions: str) -> None:
    """Writing a run again replaces that run and leaves the others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).format(fmt).save(path)


def _with_split(schema: StructType, *partitions: str) -> StructType:
    fields = [f for f in schema.fields if f.name not in partitions]
    return StructType(fields + [StructField(p, StringType()) for p in partitions])


def write_predictions(predictions: DataFrame, path: str, run: str, fmt: str = "parquet") -> None:
    """Records plus ``prediction``, one folder per run and split."""
    named = predictions.select("id", "abstract", "summary", "source", "prediction", F.lit(run).alias("name"), "split")
    _replace_partitions(named, path, fmt, "name", "split")


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(_with_split(PREDICTION, "name", "split")).format(fmt).load(path)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """One record per run and split."""
    _replace_partitions(metrics, path, fmt, "name", "split")


def write_bucketed(df: DataFrame, table: str, path: str, keys: tuple[str, ...] = ("split", "id"), buckets: int = 200) -> DataFrame:
    """Records or predictions as a table bucketed and sorted by key, so that tables of equal buckets join where they lie."""
    df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def read_metrics(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(_with_split(METRICS, "name", "split")).format(fmt).load(path)


def _run_name(split: str, ending: str):
    """The run in ``<run>__<split>.<ending>``, be it a file or a folder of part files."""
    pattern = rf"([^/]*)__{split}\.{ending}(?:/[^/]*)?$"
    file = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)
    return F.when(file != "", file).otherwise(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)))


def read_metrics_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Files named ``<run>__<split>.metrics.json``; the file name says which run it is."""
    files = spark.read.schema(METRICS).option("multiLine", True).option("mode", "FAILFAST").json(
        f"{folder}/*__{split}.metrics.json"
    )
    return files.withColumns({"name": _run_name(split, r"metrics\.json"), "split": F.lit(split)})


def read_prediction_files(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Files named ``<run>__<split>.jsonl``."""
    files = read_json_lines(spark, f"{folder}/*__{split}.jsonl", PREDICTION)
    return files.withColumns({"name": _run_name(split, "jsonl"), "split": F.lit(split)})


def append_metric_log(metrics: DataFrame, path: str, commit: str) -> None:
    """Add the metrics under a commit key; what is logged again under the same key replaces itself and nothing else."""
    _replace_partitions(metric_log(metrics).withColumn("commit", F.lit(commit)), path, "parquet", "commit", "name", "split")


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """``(commit, name, split, metric, value)`` of all commits."""
    schema = "metric string, value double, commit string, name string, split string"
    return spark.read.schema(schema).parquet(path).select("commit", "name", "split", "metric", "value")


def write_report(report: DataFrame, path: str) -> None:
    """A profile report is one row per split."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Exported run histories with the column names the tracker gave them; files of different columns are read together."""
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    return reader.format(fmt).load(path)


def write_run_factors(factors: DataFrame, path: str) -> None:
    """The run dimension: what each run varied, and when. Columns are cast to their types; a missing one is an error."""
    factors.select(*[F.col(f.name).cast(f.dataType) for f in RUN_FACTORS.fields]).write.mode("overwrite").parquet(path)


def read_run_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_FACTORS).parquet(path)
