"""Predictions: the extractive baseline, and any batched text generator."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill import fixed_values as fx
from gistmill.functions.chat import ChatTemplate, render_example
from gistmill.functions.text import clean_completion, first_sentence
from gistmill.operators.metrics import check_aligned
from gistmill.session import compute_once, new_folder

Generator = Callable[[list[str], int], list[str]]


def extractive(records: DataFrame) -> DataFrame:
    return records.withColumn("prediction", first_sentence(F.col("abstract")))


def generation_udf(
    factory: Callable[[], Generator], batch_size: int = fx.BATCH_SIZE, max_new_tokens: int = fx.MAX_NEW_TOKENS
):
    """Column function ``prompt -> completion``.

    ``factory`` runs once per task and returns ``(prompts, max_new_tokens) -> completions``.
    """

    @F.pandas_udf(T.StringType())
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generator = factory()
        for prompts in batches:
            texts = prompts.tolist()
            answers: list[str] = []
            for start in range(0, len(texts), batch_size):
                batch = texts[start : start + batch_size]
                completed = generator(batch, max_new_tokens)
                if len(completed) != len(batch):
                    raise ValueError(f"length mismatch: {len(completed)} completions vs {len(batch)} prompts")
                answers.extend(completed)
            yield pd.Series(answers, dtype=object)

    return complete


def generate(
    records: DataFrame,
    factory: Callable[[], Generator],
    template: ChatTemplate = ChatTemplate(),
    batch_size: int = fx.BATCH_SIZE,
    max_new_tokens: int = fx.MAX_NEW_TOKENS,
) -> DataFrame:
    """Records with the cleaned completion of their prompt as ``prediction``.

    Only the prompts go to Python; the other columns wait in the JVM and meet
    their completion there, so nothing is shuffled or joined. The generator cuts
    prompts to its own limit (``fx.PROMPT_MAX_LENGTH`` tokens): only its tokenizer knows where.
    """
    prompt = render_example(F.col("abstract"), template=template)
    completed = compute_once(
        records.withColumn("_completion", generation_udf(factory, batch_size, max_new_tokens)(prompt)),
        prediction=clean_completion(F.col("_completion")),
    )
    return completed.drop("_completion")


def attach_predictions(
    records: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("split", "id")
) -> DataFrame:
    """Records with predictions made elsewhere, matched by key and never by position.

    Every record must have exactly one prediction and every prediction its record;
    keys are compared before texts are joined, and anything else is an error.
    """
    check_aligned(predictions, records, keys, once=True)
    return records.join(predictions.select(*keys, "prediction"), list(keys))


def attach_bucketed(records: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("split", "id")) -> DataFrame:
    """:func:`attach_predictions` for tables bucketed by the keys (``sources.runs.write_bucketed``), in one pass.

    One full outer join checks and joins: tables of equal buckets are neither shuffled nor counted before. A
    missing, surplus or repeated key is an error as soon as its row is read.
    """
    own = Window.partitionBy(*keys)

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.count(F.lit(1)).over(own))

    held = counted(records, "_records")
    given = counted(predictions.select(*keys, "prediction"), "_predictions")
    joined = held.join(given, list(keys), "full_outer")
    single = (F.col("_records") == 1) & (F.col("_predictions") == 1)
    wrong = F.raise_error(F.concat(
        F.lit("length mismatch: "), F.coalesce("_predictions", F.lit(0)).cast("string"), F.lit(" preds vs "),
        F.coalesce("_records", F.lit(0)).cast("string"), F.lit(" refs of "), F.concat_ws(" ", *keys),
    ))
    checked = F.when(F.coalesce(single, F.lit(False)), F.col("prediction")).otherwise(wrong.cast("string"))
    # the check hangs on the prediction and on the keys, so that no choice of columns loses it
    keyed = [F.when(F.coalesce(single, F.lit(False)), F.col(k)).otherwise(wrong.cast(records.schema[k].dataType)).alias(k) for k in keys]
    rest = [c for c in records.columns if c not in (*keys, "prediction")]
    return joined.select(*keyed, *rest, checked.alias("prediction"))


def generate_resumable(
    records: DataFrame,
    factory: Callable[[], Generator],
    path: str,
    run: str,
    chunks: int = 100,
    template: ChatTemplate = ChatTemplate(),
    batch_size: int = fx.BATCH_SIZE,
    max_new_tokens: int = fx.MAX_NEW_TOKENS,
) -> DataFrame:
    """:func:`generate`, written in ``chunks`` commits to ``path``: called again it makes only what is missing.

    Records are dealt into chunks by a hash of their keys, one folder each. Each chunk is one job, which drops records whose prediction is
    there and appends the others; Spark commits a job's files together, so that a lost executor repeats its own tasks and a lost driver one
    chunk. Returns all predictions of the run, ``(split, id, prediction, name)``.
    """
    spark = records.sparkSession
    schema = "split string, id string, prediction string, chunk int, name string"
    dealt = new_folder(spark)
    chunk_of = F.pmod(F.xxhash64("split", "id"), F.lit(chunks)).cast("int")
    records.withColumn("chunk", chunk_of).write.partitionBy("chunk").parquet(dealt)
    keyed = spark.read.schema(T.StructType([*records.schema.fields, T.StructField("chunk", T.IntegerType())])).parquet(dealt)

    def written() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(path).filter(F.col("name") == run)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    for chunk in range(chunks):
        there = written().filter(F.col("chunk") == chunk)
        open_ = keyed.filter(F.col("chunk") == chunk).join(there, ["split", "id"], "left_anti")
        made = generate(open_, factory, template, batch_size, max_new_tokens)
        made.select("split", "id", "prediction", "chunk", F.lit(run).alias("name")).write.mode("append").partitionBy("name", "chunk").parquet(path)
    return written().select("split", "id", "prediction", "name")
