import hashlib
from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from gistmill.operators import ordering as o


def records(spark, n=500):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"),
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"),
        F.col("id").alias("pos"),
    )


def digest(*parts):
    return hashlib.sha256(":".join(parts).encode()).hexdigest()


def test_shuffle_is_seeded_and_does_not_depend_on_partitioning(spark):
    df = records(spark, 60)
    got = [(r.split, r.id) for r in o.shuffled(df).collect()]
    rows = [(r.split, r.id) for r in df.collect()]
    assert got == sorted(rows, key=lambda r: (r[0], digest("1337", *r)))
    assert got == [(r.split, r.id) for r in o.shuffled(df.repartition(7)).collect()]
    assert got != [(r.split, r.id) for r in o.shuffled(df, seed=1).collect()]


def test_positions_match_the_shuffled_order(spark):
    df = records(spark)
    got = {(r.split, r.id): r.position for r in o.number_shuffled(df).collect()}
    for split in ("train", "val"):
        keys = sorted((k for k in got if k[0] == split), key=lambda k: digest("1337", *k))
        assert [got[k] for k in keys] == list(range(1, len(keys) + 1))


def test_one_large_group_is_numbered_in_pieces(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1999, "hot").otherwise("cold").alias("g"), F.col("id").alias("at"))
    numbered = o.number_rows(df, [F.col("at")], F.floor(F.col("at") / 100), ["g"])
    assert sorted((r.at, r.position) for r in numbered.collect()) == [(i, i + 1) for i in range(1999)] + [(1999, 1)]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(g" in plan and "_bucket" in plan


def test_rows_without_a_place_are_an_error(spark):
    df = spark.createDataFrame([("g", 1), (None, 2), ("g", None)], "g string, at long")
    for bad in (df.filter("at is not null"), df.filter("g is not null")):
        with pytest.raises(Exception, match="null bucket or group"):
            o.number_rows(bad, [F.col("at")], F.col("at"), ["g"]).collect()
    assert o.number_rows(df.na.drop(), [F.col("at")], F.col("at"), ["g"]).first().position == 1


def test_buckets_stay_small_however_many_rows():
    assert [o.bucket_digits(n) for n in (0, 1 << 24, (1 << 24) + 1, 25_000_000_000)] == [2, 2, 3, 5]


def test_one_large_group_without_natural_buckets(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 990, "hot").otherwise("cold").alias("g"), F.col("id").alias("at"))
    ranked = o.rank_rows(df, [F.col("at").desc()], by=["g"])
    assert {(r.at, r.position) for r in ranked.collect()} == {(i, 990 - i if i < 990 else 1000 - i) for i in range(1000)}


def test_rank_rows_over_everything(spark):
    df = spark.range(777).select((F.col("id") * 7919 % 777).alias("v"))
    ranked = o.rank_rows(df, [F.col("v").desc()])
    assert {(r.v, r.position) for r in ranked.collect()} == {(v, 777 - v) for v in range(777)}


def test_head_and_sample(spark):
    df = records(spark, 50)
    assert [r.pos for r in o.head(df, 3).collect()] == [0, 1, 2]
    assert o.head(df, 0).count() == 50
    assert o.head(df, 64).count() == 50
    first = sorted(r.id for r in o.sample_rows(df, 4).collect())
    assert first == sorted(r.id for r in o.sample_rows(df.repartition(5), 4).collect()) and len(set(first)) == 4
    with pytest.raises(ValueError, match="larger than population"):
        o.sample_rows(df, 51)


def test_only_the_last_batch_is_short(spark):
    batched = o.assign_batches(o.number_shuffled(records(spark, 103), by=()), 4)
    sizes = sorted((r.batch_id, r["count"]) for r in batched.groupBy("batch_id").count().collect())
    assert sizes == [(i, 4) for i in range(25)] + [(25, 3)]


def brute_batches(lengths, budget, block_rows):
    """Batch and longest by place: each block's rows from the longest, a batch as large as its first row allows."""
    found, number = {}, 0
    for start in range(0, len(lengths), block_rows):
        rows = sorted(range(start, min(start + block_rows, len(lengths))), key=lambda i: (-lengths[i], i))
        while rows:
            longest = lengths[rows[0]]
            take = max(1, budget // max(longest, 1))
            found |= {i: (number, longest) for i in rows[:take]}
            rows, number = rows[take:], number + 1
    return found


@pytest.mark.parametrize("partitions", [1, 7])
def test_token_batches_equal_brute_force(spark, partitions):
    random = Random(5)
    # a block of one row, equal lengths, empty rows, and a row beyond the budget
    lengths = [random.choice([0, 1, 3, 3, 8, 30, 70]) for _ in range(201)]
    rows = spark.createDataFrame([("s", i + 1, n) for i, n in enumerate(lengths)], "split string, position long, n int")
    batched = o.assign_token_batches(rows.repartition(partitions), 60, "n", block_rows=50).collect()
    assert {r.position - 1: (r.batch_id, r.longest) for r in batched} == brute_batches(lengths, 60, 50)
    sizes = Counter(r.batch_id for r in batched)
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(sizes[r.batch_id] * r.longest <= 60 or sizes[r.batch_id] == 1 for r in batched)


def test_token_batches_of_missing_lengths_splits_and_no_rows(spark):
    schema = "split string, position long, n int"
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, 5), ("b", 2, 5)], schema)
    found = {(r.split, r.position): (r.batch_id, r.longest) for r in o.assign_token_batches(rows, 5, "n").collect()}
    assert found == {("a", 2): (0, 5), ("a", 1): (1, 0), ("b", 1): (0, 5), ("b", 2): (1, 5)}
    empty = o.assign_token_batches(spark.createDataFrame([], schema), 5, "n")
    assert empty.columns == ["split", "position", "n", "batch_id", "longest"] and not empty.collect()


def test_token_batches_pad_less(spark):
    random = Random(6)
    rows = spark.createDataFrame([("s", i + 1, int(random.expovariate(0.02)) + 1) for i in range(2000)], "split string, position long, n int")
    by_rows = o.padding_share(o.assign_batches(rows, 8), "n").first()
    by_tokens = o.padding_share(o.assign_token_batches(rows, 1000, "n"), "n").first()
    assert by_rows.tokens == by_tokens.tokens and by_tokens.padding * 5 < by_rows.padding
