import json

import pytest
from pyspark.sql import functions as F

from gistmill.operators.results import display_dimension, mean_output_words, results_table
from gistmill.plans import flows
from gistmill.operators.predict import extractive
from gistmill.sources import records as rec
from gistmill.sources import runs

LONG = "An abstract sentence about méthodes. " * 5
PAPERS = [{"source": [LONG, f"Number {i}."], "target": [f"A summary of paper {i}.", "other"]} for i in range(8)]


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")


def test_split_file(spark, tmp_path):
    rows = [
        {"id": "k7", "abstract": "Moss grows on the north side.", "summary": "Moss likes shade.", "source": "garden"},
        {"id": "k9", "abstract": "Tides follow the moon.", "summary": "The moon moves water.", "source": "coast"},
        {"id": "m2", "abstract": "Über allen Gipfeln ist Ruh.", "summary": None, "source": "poem"},
    ]
    lines(tmp_path / "train.jsonl", rows)
    got = sorted(rec.read_split(spark, str(tmp_path), "train").collect())
    assert [tuple(r[:4]) for r in got] == [tuple(r.values()) for r in rows]
    assert {r.split for r in got} == {"train"}


def test_blank_lines_are_skipped_and_bad_ones_fail(spark, tmp_path):
    good = '{"id":"a"}\n\n   \n{"id":"b"}\n'
    (tmp_path / "ok.jsonl").write_text(good)
    (tmp_path / "bad.jsonl").write_text(good + "{oops\n")
    assert rec.read_split(spark, str(tmp_path), "ok").count() == 2
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        rec.read_split(spark, str(tmp_path), "bad").collect()


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_prepared_corpus_round_trip(spark, tmp_path, fmt):
    for split in ("train", "validation", "test"):
        lines(tmp_path / f"raw-{split}.jsonl", PAPERS)
    raw = rec.read_papers(spark, {s: str(tmp_path / f"raw-{s}.jsonl") for s in ("train", "validation", "test")})
    out = str(tmp_path / f"prepared-{fmt}")
    sizes = flows.prepare_corpus(raw.withColumn("pos", F.monotonically_increasing_id()), out, "papers", fmt=fmt)
    assert {tuple(r) for r in sizes.collect()} == {("train", 8), ("val", 8), ("test", 8)}
    back = rec.read_records(spark, out, fmt)
    row = back.filter("split = 'val'").orderBy("summary").first()
    assert "méthodes" in row.abstract and row.source == "papers" and row.summary == "A summary of paper 0."
    plan = back.filter("split = 'val'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    if fmt == "json":
        written = next((tmp_path / "prepared-json" / "split=val").glob("part-*")).read_text(encoding="utf-8")
        assert "méthodes" in written
    rec.write_split_sizes(back, str(tmp_path / "sizes"))
    assert spark.read.json(str(tmp_path / "sizes")).count() == 3


def test_partitioned_papers(spark, tmp_path):
    for split in ("train", "test"):
        lines(tmp_path / "papers" / f"split={split}" / "x.json", PAPERS)
    assert {r.split for r in rec.read_papers(spark, str(tmp_path / "papers")).collect()} == {"train", "test"}


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "s", "x", "train")], "id string, abstract string, summary string, source string, split string")
    rec.write_records(df, str(tmp_path / "r"), "json")
    assert '"abstract":null' in next((tmp_path / "r" / "split=train").glob("part-*")).read_text()


def test_run_is_written_scored_and_rewritten(spark, tmp_path):
    records = spark.createDataFrame(
        [(f"i{i}", f"First one {i}. Second part {i}.", f"First one {i}.", "s", "val") for i in range(5)],
        "id string, abstract string, summary string, source string, split string",
    )
    paths = str(tmp_path / "predictions"), str(tmp_path / "metrics")
    for _ in range(2):
        metrics = flows.predict_and_score(records, extractive, "first", *paths)
    row = metrics.first()
    assert metrics.count() == 1 and (row.name, row.split, row.rouge1, row.n) == ("first", "val", 1.0, 5)
    flows.predict_and_score(records, lambda r: r.withColumn("prediction", F.lit("nothing")), "empty", *paths)
    predictions = runs.read_predictions(spark, paths[0])
    assert predictions.count() == 10
    words = mean_output_words(predictions)
    table = results_table(runs.read_metrics(spark, paths[1]), words, display_dimension(spark, {"first": "First"}, {}))
    assert [(r.section, r.name, r.rouge1, r.words) for r in table.collect()] == [(0, "first", 1.0, 3.0), (2, "empty", 0.0, 1.0)]
    plan = predictions.filter("name = 'first' and split = 'val'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan


def test_missing_predictions_stop_the_run(spark, tmp_path):
    records = spark.createDataFrame([("a", "A. B.", "A.", "s", "val"), ("b", "A. B.", "A.", "s", "val")],
                                    "id string, abstract string, summary string, source string, split string")
    with pytest.raises(ValueError, match="length mismatch"):
        flows.predict_and_score(records, lambda r: extractive(r).limit(1), "x", str(tmp_path / "p"), str(tmp_path / "m"))


def test_files_named_after_runs(spark, tmp_path):
    for run, split in (("zero_shot__M-1", "val"), ("base", "val"), ("base", "test")):
        body = {"name": "ignored", "rouge1": 0.5, "rouge2": 0.25, "rougeL": 0.5, "bertscore_f1": 0.75, "n": 3}
        (tmp_path / f"{run}__{split}.metrics.json").write_text(json.dumps(body, indent=2))
        lines(tmp_path / f"{run}__{split}.jsonl", [{"id": "a", "prediction": "two words"}, {"id": "b"}])
    metrics = runs.read_metrics_files(spark, str(tmp_path), "val")
    assert {(r.name, r.split, r.n) for r in metrics.collect()} == {("zero_shot__M-1", "val", 3), ("base", "val", 3)}
    words = mean_output_words(runs.read_prediction_files(spark, str(tmp_path), "val"))
    assert {(r.name, r.words) for r in words.collect()} == {("zero_shot__M-1", 2.0), ("base", 2.0)}


def test_logs_reports_and_histories(spark, tmp_path):
    metrics = spark.createDataFrame([("r", "val", 0.5, 3)], "name string, split string, rouge1 double, n long")
    other = spark.createDataFrame([("s", "val", 0.25, 3)], "name string, split string, rouge1 double, n long")
    for commit, logged in (("a", metrics), ("a", metrics), ("b", other), ("b", metrics), ("b", other.withColumn("rouge1", F.lit(0.75)))):
        runs.append_metric_log(logged, str(tmp_path / "log"), commit)
    log = runs.read_metric_log(spark, str(tmp_path / "log"))
    assert {(r.commit, r.name, r.value) for r in log.filter("metric = 'rouge1'").collect()} == {("a", "r", 0.5), ("b", "r", 0.5), ("b", "s", 0.75)}
    assert log.count() == 6 and log.columns == ["commit", "name", "split", "metric", "value"]
    records = spark.createDataFrame([("train", "i", "a b c", "a")], "split string, id string, abstract string, summary string")
    flows.corpus_profile(records, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().abstract_tokens.max == 3
    history = spark.createDataFrame([(1, 2.0)], "_step long, `train/loss` double")
    history.write.parquet(str(tmp_path / "history"))
    assert runs.read_history(spark, str(tmp_path / "history")).columns == ["_step", "train/loss"]
