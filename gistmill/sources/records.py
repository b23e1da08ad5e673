"""Papers and prepared records: JSON lines or Parquet, one folder per split."""

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gistmill.operators.prepare import split_sizes
from gistmill.schemas import RAW_PAPER, RECORD


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object per line. Blank lines are skipped, malformed ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _read(spark: SparkSession, path: str, schema: StructType, fmt: str) -> DataFrame:
    if fmt == "json":
        return read_json_lines(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def read_papers(spark: SparkSession, paths: str | Mapping[str, str], fmt: str = "json") -> DataFrame:
    """Nested papers with a ``split`` column: a partitioned folder, or one path per split."""
    if isinstance(paths, str):
        return _read(spark, paths, StructType(RAW_PAPER.fields).add("split", "string"), fmt)
    parts = [_read(spark, path, RAW_PAPER, fmt).withColumn("split", F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def read_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Prepared records of every split; filter on ``split`` to read only its folder."""
    return _read(spark, path, StructType(RECORD.fields).add("split", "string"), fmt)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split kept as a single ``<split>.jsonl`` file."""
    return read_json_lines(spark, f"{folder}/{split}.jsonl", RECORD).withColumn("split", F.lit(split))


def write_records(records: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per split. JSON keeps nulls and writes non-ASCII text as it is."""
    columns = records.select("id", "abstract", "summary", "source", "split")
    writer = columns.write.mode("overwrite").partitionBy("split").format(fmt)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(path)


def read_split_sizes(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, StructType().add("split", "string").add("n", "long"))


def write_split_sizes(records: DataFrame, path: str) -> None:
    split_sizes(records).coalesce(1).write.mode("overwrite").json(path)
