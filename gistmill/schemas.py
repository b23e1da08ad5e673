"""Explicit schemas: nothing is inferred from data."""

from pyspark.sql import types as T

RAW_PAPER = T.StructType([
    T.StructField("source", T.ArrayType(T.StringType())),
    T.StructField("target", T.ArrayType(T.StringType())),
])

RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("source", T.StringType()),
])

PREDICTION = T.StructType(RECORD.fields + [T.StructField("prediction", T.StringType())])

METRICS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("rouge1", T.DoubleType()),
    T.StructField("rouge2", T.DoubleType()),
    T.StructField("rougeL", T.DoubleType()),
    T.StructField("bertscore_f1", T.DoubleType()),
    T.StructField("n", T.LongType()),
])

HISTORY = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
])

RUN_FACTORS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("valid_from", T.DateType()),
    T.StructField("valid_to", T.DateType()),
    T.StructField("model", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("trainable_params", T.LongType()),
])

DISPLAY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("deprecated", T.BooleanType()),
])
