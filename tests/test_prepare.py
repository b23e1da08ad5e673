from pyspark.sql import functions as F

from gistmill.operators import prepare as prep

LONG = "word " * 30
RAW = "pos long, split string, source array<string>, target array<string>"


def prepare(spark, rows):
    raw = spark.createDataFrame(rows, RAW)
    return prep.prepare_records(raw, "src")


def test_unusable_rows_are_dropped(spark):
    rows = [
        (1, "train", None, ["a good long summary"]),
        (2, "train", [LONG], []),
        (3, "train", [], ["a good long summary"]),
        (4, "train", [LONG], None),
        (5, "train", [LONG], ["", "good long summary"]),
        (6, "train", ["x" * 99], ["s" * 10]),
        (7, "train", ["x" * 100], ["s" * 9]),
        (8, "train", ["x" * 100], ["s" * 10]),
    ]
    assert [r.pos for r in prepare(spark, rows).collect()] == [8]


def test_lengths_are_taken_after_cleaning(spark):
    rows = [(1, "train", ["x" * 50 + " " * 60], ["s" * 10]), (2, "train", ["  y" * 60, "z z"], [" a  longer\tone "])]
    (row,) = prepare(spark, rows).collect()
    assert row.abstract == "y " * 60 + "z z" and row.summary == "a longer one"
    assert row.source == "src" and len(row.id) == 16


def test_first_copy_of_each_split_is_kept(spark):
    rows = [
        (3, "train", [LONG], ["second summary"]),
        (1, "train", [LONG], ["first summary"]),
        (2, "validation", [LONG], ["dev summary"]),
        (4, "train", [LONG + "more"], ["other summary"]),
    ]
    records = prepare(spark, rows)
    assert {(r.split, r.summary) for r in records.collect()} == {
        ("train", "first summary"), ("val", "dev summary"), ("train", "other summary"),
    }
    again = prep.keep_first(records)
    assert sorted(again.collect()) == sorted(records.select(again.columns).collect())
    assert {tuple(r) for r in prep.split_sizes(records).collect()} == {("train", 2), ("val", 1)}


def test_cleaning_is_computed_once(spark):
    raw = spark.createDataFrame([], RAW)
    plan = prep.clean_papers(raw, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_null_sentence_is_skipped(spark):
    (row,) = prepare(spark, [(1, "test", [LONG, None, "end"], ["a summary here"])]).collect()
    assert row.abstract == LONG.strip() + " end" and row.split == "test"


def test_much_copied_text_is_reduced_before_the_shuffle(spark):
    copies = spark.range(5000).select(
        F.col("id").alias("pos"), F.lit("train").alias("split"),
        F.array(F.lit(LONG)).alias("source"), F.array(F.lit("a summary here")).alias("target"),
    )
    records = prep.prepare_records(copies, "s")
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(" in plan and "ShuffledHashJoin" in plan
    assert not [line for line in plan.split("\n") if "Sort" in line and "abstract" in line]
    assert [r.pos for r in records.collect()] == [0]


def test_ids_that_meet_stay_apart(spark, monkeypatch):
    """With one digit of the digest as id, different texts must share ids; none may be lost."""
    monkeypatch.setattr(prep.fx, "ID_HEX_CHARS", 1)
    rows = [(i, "train", [f"{LONG} number {i % 40}"], ["a summary here"]) for i in range(120)]
    got = prepare(spark, rows).collect()
    assert sorted(r.pos for r in got) == list(range(40))
    assert len({r.id for r in got}) == 40 and 2 <= sum(len(r.id) == 1 for r in got) <= 16
