from pyspark.sql import functions as F

from gistmill.functions.text import content_id, first_sentence, squeeze_whitespace


def test_row_functions_work_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("One  here. Two.",), ("x",)], "text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").json(str(tmp_path / "in"))
    out = stream.select(first_sentence(squeeze_whitespace(F.col("text"))).alias("s")).withColumn("id", content_id(F.col("s")))
    query = (
        out.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(60)
    assert {r.s for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"One here.", "x"}
