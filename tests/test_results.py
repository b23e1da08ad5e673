import datetime as dt

import pytest
from pyspark.sql import functions as F

from gistmill.operators import history as h
from gistmill.operators import results as res
from gistmill.schemas import METRICS, RUN_FACTORS
from gistmill.sources import runs as run_io

PUBLISHED = {
    ("extractive_first_sentence", "test"): (0.259, 0.093, 0.201, 0.636),
    ("zero_shot_neutral__Llama-3.2-1B-Instruct", "test"): (0.299, 0.102, 0.227, 0.655),
    ("zero_shot_neutral__Llama-3.2-3B-Instruct", "test"): (0.342, 0.131, 0.258, 0.673),
    ("qlora_3b_r8", "test"): (0.387, 0.166, 0.314, 0.705),
    ("extractive_first_sentence", "val"): (0.259, 0.093, 0.205, 0.637),
    ("zero_shot_neutral__Llama-3.2-1B-Instruct", "val"): (0.302, 0.102, 0.229, 0.657),
    ("zero_shot_neutral__Llama-3.2-3B-Instruct", "val"): (0.337, 0.131, 0.258, 0.674),
    ("qlora_3b_r8", "val"): (0.404, 0.184, 0.333, 0.712),
    ("qlora_3b_r16", "val"): (0.402, 0.183, 0.333, 0.711),
    ("zero_shot__Llama-3.2-1B-Instruct", "val"): (0.297, 0.096, 0.223, 0.657),
    ("zero_shot__Llama-3.2-3B-Instruct", "val"): (0.274, 0.072, 0.201, 0.657),
}


def metrics_of(spark, rows):
    schema = METRICS.add("split", "string") if "split" not in METRICS.names else METRICS
    return spark.createDataFrame([(n, *s, 618, split) for (n, split), s in rows.items()], schema)


@pytest.fixture(scope="module")
def metrics(spark):
    return metrics_of(spark, PUBLISHED)


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("qlora_3b_r8", "val", 21.46)], "name string, split string, words double")


def table(spark, metrics, words, split="val", **options):
    rows = res.results_table(metrics.filter(f"split = '{split}'"), words, res.display_dimension(spark), **options).collect()
    return [(r.section, r.name, r.is_best) for r in rows], rows


def test_order_and_best(spark, metrics, words):
    order, rows = table(spark, metrics, words)
    assert order == [
        (0, "extractive_first_sentence", False),
        (0, "zero_shot_neutral__Llama-3.2-1B-Instruct", False),
        (0, "zero_shot_neutral__Llama-3.2-3B-Instruct", False),
        (0, "qlora_3b_r8", True),
        (0, "qlora_3b_r16", False),
    ]
    assert rows[3].words == 21.5 and rows[0].words is None
    assert rows[3].label == "QLoRA 3B, rank=8" and rows[3].rouge1 == 0.404


def test_deprecated_runs_only_on_request(spark, metrics, words):
    with_old, _ = table(spark, metrics, words, include_deprecated=True)
    assert [n for s, n, _ in with_old if s == 1] == ["zero_shot__Llama-3.2-1B-Instruct", "zero_shot__Llama-3.2-3B-Instruct"]
    without, _ = table(spark, metrics, words)
    assert not any("zero_shot__" in n for _, n, _ in without)


def test_unlisted_runs_come_last_by_file_name(spark, words):
    extra = {("zz", "val"): (0.9,) * 4, ("a_b", "val"): (0.1,) * 4, ("a", "val"): (0.1,) * 4, ("qlora_new", "val"): (0.99,) * 4}
    order, rows = table(spark, metrics_of(spark, PUBLISHED | extra), words)
    assert [n for s, n, _ in order if s == 2] == ["a", "a_b", "qlora_new", "zz"]
    assert [n for _, n, best in order if best] == ["qlora_3b_r8"]
    assert rows[-1].label == "zz"


def test_best_run_ties_and_missing_scores(spark):
    rows = [("qlora_b", "v", 0.5, 1), ("qlora_a", "v", 0.5, 0), ("qlora_c", "v", None, 2), ("other", "v", 0.9, 3)]
    df = spark.createDataFrame(rows, "name string, split string, rouge1 double, ord int")
    assert [r.best for r in res.best_run(df).collect()] == ["qlora_a"]
    assert res.best_run(df.filter("name = 'qlora_c'")).count() == 0


def test_mean_output_words(spark):
    rows = [("r", "val", None), ("r", "val", ""), ("r", "val", "a b"), ("none", "val", None)]
    df = spark.createDataFrame(rows, "name string, split string, prediction string")
    assert {r.name: r.words for r in res.mean_output_words(df).collect()} == {"r": 1.0, "none": None}


def test_published_gains(metrics):
    base = "zero_shot_neutral__Llama-3.2-3B-Instruct"
    row = res.gains_over(metrics.filter("split = 'test'"), base).filter("name = 'qlora_3b_r8'").first()
    assert [round(row[f"{s}_relative"] * 100, 1) for s in res.SCORES] == [13.2, 26.7, 21.7, 4.8]
    assert row.rouge1_gain == pytest.approx(0.045)


def test_published_split_gap(metrics):
    gaps = {r.name: r.rouge1_gap for r in res.split_gap(metrics).collect()}
    assert gaps["qlora_3b_r8"] == pytest.approx(-0.017) and gaps["extractive_first_sentence"] == 0
    assert gaps["qlora_3b_r16"] is None


def test_published_prompt_ablation(spark, metrics):
    names = [(f"zero_shot{v}__Llama-3.2-{m}-Instruct", m, p) for m in ("1B", "3B") for v, p in (("", "plain"), ("_neutral", "neutral"))]
    factors = spark.createDataFrame(names, "name string, model string, prompt string")
    joined = metrics.filter("split = 'val'").join(factors, "name")
    wide = res.ablation_table(joined, ["model"], "prompt", ["plain", "neutral"], ["rouge1", "rougeL"])
    deltas = {r.model: r for r in res.variant_deltas(wide, "plain", "neutral", ["rouge1", "rougeL"]).collect()}
    assert deltas["3B"].rouge1_delta == pytest.approx(0.063) and deltas["1B"].rouge1_delta == pytest.approx(0.005)
    assert deltas["3B"].plain_rougeL == 0.201


def test_metric_log_has_numbers_only(metrics):
    log = res.metric_log(metrics.filter("name = 'qlora_3b_r16'"))
    assert {(r.metric, r.value) for r in log.collect()} == {
        ("rouge1", 0.402), ("rouge2", 0.183), ("rougeL", 0.333), ("bertscore_f1", 0.711), ("n", 618.0),
    }


# --- run history ----------------------------------------------------------------


def test_canonical_history(spark):
    df = spark.createDataFrame([("r", 1, 2.0, None)], "run_id string, _step long, `train/loss` double, `train/learning_rate` double")
    canonical = h.canonical_history(df)
    assert canonical.columns == ["run_id", "step", "train_loss", "learning_rate"]
    assert [r.series for r in h.sparse_series(canonical).collect()] == ["train_loss"]
    with pytest.raises(ValueError, match="step"):
        h.canonical_history(df.drop("_step"))
    with pytest.raises(ValueError, match="train_loss"):
        h.canonical_history(df.drop("train/loss"))


def test_first_candidate_wins():
    assert h.first_existing(["step", "_step"], ["_step", "global_step", "step"]) == "_step"
    assert h.first_existing(["x"], ["a"]) is None


@pytest.fixture(scope="module")
def run(spark):
    rows = [("r", s, 3.0 - s / 100, {25: 2.2, 50: 2.0, 75: 2.1, 100: 2.0}.get(s), None) for s in range(5, 105, 5)]
    return spark.createDataFrame(rows, "run_id string, step long, train_loss double, eval_loss double, learning_rate double")


def test_series_are_sparse_and_in_step_order(run):
    series = h.in_step_order(h.sparse_series(run)).collect()
    assert [r.step for r in series if r.series == "eval_loss"] == [25, 50, 75, 100]
    assert len(series) == 24


def test_step_grid(run):
    assert sorted(r.step for r in h.every_steps(run, 10).collect()) == list(range(10, 105, 10))


def test_best_checkpoint_prefers_the_earliest(run):
    assert [tuple(r) for r in h.best_checkpoint(run).collect()] == [("r", 50, 2.0)]


@pytest.mark.parametrize("keep, kept", [(1, {50, 100}), (2, {50, 100}), (3, {50, 75, 100}), (9, {25, 50, 75, 100})])
def test_retained_checkpoints(run, keep, kept):
    rows = h.retained_checkpoints(run, keep=keep).collect()
    assert {r.step for r in rows} == kept and [r.step for r in rows if r.is_best] == [50]


def test_retained_when_the_latest_is_best_or_nothing_was_evaluated(spark, run):
    improving = run.filter("step <> 50")
    assert {r.step for r in h.retained_checkpoints(improving).collect()} == {75, 100}
    assert {r.step for r in h.retained_checkpoints(improving, keep=1).collect()} == {100}
    blind = run.drop("eval_loss").selectExpr("*", "cast(null as double) eval_loss")
    assert {r.step for r in h.retained_checkpoints(blind).collect()} == {75, 100}
    assert {r.step for r in h.retained_checkpoints(blind, keep=1).collect()} == {100}


def test_a_split_without_the_baseline_keeps_its_runs(spark):
    rows = [("base", "val", 0.5), ("mine", "val", 0.6), ("mine", "test", 0.4)]
    metrics = spark.createDataFrame(rows, "name string, split string, rouge1 double")
    got = {(r.name, r.split): r.rouge1_gain for r in res.gains_over(metrics, "base", ["rouge1"]).collect()}
    assert got == {("base", "val"): 0.0, ("mine", "val"): pytest.approx(0.1), ("mine", "test"): None}


def test_two_runs_in_one_cell_are_an_error(spark):
    rows = [("a", "val", "x", 0.5), ("b", "val", "x", 0.6)]
    metrics = spark.createDataFrame(rows, "name string, split string, variant string, rouge1 double")
    with pytest.raises(Exception, match="several runs"):
        res.ablation_table(metrics, ["split"], "variant", ["x"]).collect()


def test_each_run_has_its_own_names(spark):
    """Runs of different names read together; a run's leftover under another name isn't mixed in."""
    rows = [
        ("a", 1, None, 2.0, None, None), ("a", 2, None, None, 9.0, 0.5), ("b", None, 1, None, 3.0, None), ("b", None, 2, None, 4.0, None),
        ("c", 5, None, None, None, 1.5), (None, 7, None, None, 8.0, None),
    ]
    df = spark.createDataFrame(rows, "run_id string, _step long, global_step long, `train/loss` double, loss double, eval_loss double")
    expected = {("a", 1, 2.0, None), ("a", 2, None, 0.5), ("b", 1, 3.0, None), ("b", 2, 4.0, None), ("c", 5, None, 1.5), (None, 7, 8.0, None)}
    for limit in (1 << 20, -1):
        with pytest.MonkeyPatch.context() as patch:
            true_fits = h.lookup.fits_broadcast
            patch.setattr(h.lookup, "fits_broadcast", lambda table, size: true_fits(table, size, limit))
            out = h.canonical_history(df)
            assert {tuple(r) for r in out.collect()} == expected
    assert out.schema["step"].dataType.simpleString() == "bigint"
    with pytest.raises(Exception, match="no train_loss logged by run c"):
        h.canonical_history(df, strict=True).collect()
    with pytest.raises(Exception, match="no step logged by run d"):
        h.canonical_history(spark.createDataFrame([("d", None, 2.0)], "run_id string, step long, loss double")).collect()
    alone = h.canonical_history(df.filter("run_id = 'b'").drop("run_id"))
    assert {tuple(r) for r in alone.collect()} == {(1, 3.0, None), (2, 4.0, None)}


#: matrices of a layer that the adapters of the published runs change: inputs, outputs
PUBLISHED_SHAPES = [(3072, 3072), (3072, 1024), (3072, 1024), (3072, 3072), (3072, 8192), (3072, 8192), (8192, 3072)]


def test_rank_table_from_the_run_dimension(spark, tmp_path):
    runs = spark.createDataFrame(
        [(f"qlora_3b_r{r}", None, None, "3B", "neutral", r) for r in (8, 16)],
        "name string, valid_from string, valid_to string, model string, variant string, rank long",
    )
    path = str(tmp_path / "factors")
    run_io.write_run_factors(runs.withColumn("trainable_params", res.adapter_parameters(F.col("rank"), PUBLISHED_SHAPES, 28)), path)
    factors = run_io.read_run_factors(spark, path)
    assert factors.schema == RUN_FACTORS
    metrics = metrics_of(spark, PUBLISHED).filter("split = 'val' and name like 'qlora%'").withColumn("logged_at", F.lit("2024-05-01").cast("date"))
    table = res.factors_at(metrics, factors).orderBy("rank").collect()
    assert [(r["rank"], round(r.trainable_params / 1e6, 2), r.rouge1, r.rouge2, r.rougeL, r.bertscore_f1) for r in table] == [
        (8, 12.16, 0.404, 0.184, 0.333, 0.712), (16, 24.31, 0.402, 0.183, 0.333, 0.711),
    ]


def factor_rows(spark, rows):
    date = lambda day: day and dt.date(2024, 1, day)
    return spark.createDataFrame([(n, date(a), date(b), "m", "v", r, 0) for n, a, b, r in rows], RUN_FACTORS)


def test_factors_hold_from_their_first_day_to_the_day_before_their_end(spark):
    factors = factor_rows(spark, [("a", 2, 4, 8), ("a", 4, None, 16), ("b", None, 3, 4)])
    days = [("a", d) for d in (1, 2, 3, 4, 9)] + [("b", 2), ("b", 3), ("c", 2)]
    logged = spark.createDataFrame([(n, dt.date(2024, 1, d)) for n, d in days], "name string, logged_at date")
    found = {(r.name, r.logged_at.day): r["rank"] for r in res.factors_at(logged, factors).collect()}
    assert found == {
        ("a", 1): None, ("a", 2): 8, ("a", 3): 8, ("a", 4): 16, ("a", 9): 16, ("b", 2): 4, ("b", 3): None, ("c", 2): None,
    }


@pytest.mark.parametrize("rows", [[("a", 1, 5, 8), ("a", 4, None, 16)], [("a", None, None, 8), ("a", 4, 5, 16)], [("a", 2, 3, 8), ("a", 2, 3, 16)]])
def test_overlapping_factors_are_an_error(spark, rows):
    logged = spark.createDataFrame([("a", dt.date(2024, 1, 4))], "name string, logged_at date")
    with pytest.raises(Exception, match="overlapping factors of run a"):
        res.factors_at(logged, factor_rows(spark, rows)).collect()
