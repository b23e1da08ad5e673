"""The Jaccard join against all pairs, in several layouts; totals of values against a count."""

import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, corpus, fold, frame, order, vocabulary, words
from pyspark.sql import functions as F

from gistmill.llm import jaccard_join as module
from gistmill.llm import tables
from gistmill.llm.jaccard_join import jaccard_join
from gistmill.llm.oracles import OP12
from gistmill.llm.value_totals import layout, totals_of, with_totals


def shingles(text, width):
    found = words(fold(text or ""))
    return {tuple(found[k:k + width]) for k in range(len(found) - width + 1)} if len(found) >= width else {tuple(found)} if found else set()


def brute(rows, width=3, part=90):
    """Rows of an id are one document; an empty row stays by itself."""
    sets = [(order(i), shingles(text, width)) for i, text in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            both = len(s & t)
            if both and 100 * both >= part * (len(s | t)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    named = [(i, len(s), find(i) if s else i) for i, s in sets]
    null = lambda x: None if x == order(None) else x
    return sorted(((null(i), n, null(c)) for i, n, c in named), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near(seed, groups, each, size, vocabulary_size=3000):
    """Groups of copies with a few words changed, added and removed, each different."""
    rng, out = random.Random(seed), []
    known = vocabulary(rng, vocabulary_size)
    for g in range(groups):
        base = rng.choices(known, k=size)
        for k in range(each):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 50))):
                at = rng.randrange(len(text))
                text[at:at + rng.randint(0, 1)] = rng.choices(known, k=rng.randint(0, 2))
            out.append((10_000 * (g + 1) + k * 7 % 97, " ".join(text)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("partitions,plan", [(1, None), (5, (1, 1, 1)), (3, (4, 2, 4)), (4, (2, 4, 1))])
def test_against_all_pairs(spark, partitions, plan):
    rows = corpus(11, 150) + awkward() + near(1, 6, 12, 150)
    assert found(jaccard_join(frame(spark, rows, partitions), plan=plan)) == brute(rows)


@pytest.mark.parametrize("cell,chunk,part", [(4, 300, 90), (3, 1, 75), (1024, 1 << 17, 60)])
def test_small_cells_and_chunks(spark, monkeypatch, cell, chunk, part):
    """Frequent shingles, and components that meet in shingles without being similar."""
    monkeypatch.setattr(module, "CELL", cell)
    monkeypatch.setattr(module, "CHUNK", chunk)
    rng = random.Random(7)
    rows = near(2, 3, 40, 60, 60)
    common = " ".join(rng.choices(vocabulary(rng, 50), k=40))
    rows += [(500 + k, common + " " + " ".join(f"w{(k * 13 + j) % 29}" for j in range(k % 9))) for k in range(60)]
    assert found(jaccard_join(frame(spark, rows), part=part)) == brute(rows, part=part)


def test_exact_threshold_and_equal_ids(spark):
    """Similarities just at the bound; rows of one id that link others; no rows."""
    base = [f"a{k}" for k in range(21)]
    at = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["z"])), (3, " ".join(base[1:] + ["y"]))]
    # 19 shingles; one replaced: 18 of 20
    assert found(jaccard_join(frame(spark, at))) == brute(at)
    assert found(jaccard_join(frame(spark, at))) == [(1, 19, 1), (2, 19, 1), (3, 19, 1)]
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "pq"]
    rows = [(1, texts[0]), (2, texts[1]), (5, texts[0]), (5, texts[1]), (5, None), (6, ""), (7, "p1"), (8, "P1"), (9, "p1 p2")]
    for some in (rows, rows[::-1]):
        for partitions in (1, 4):
            assert found(jaccard_join(frame(spark, some, partitions))) == brute(rows)
    assert found(jaccard_join(frame(spark, []))) == [] and found(jaccard_join(frame(spark, [(1, None)]))) == [(1, 0, 1)]


def test_sql(spark):
    rows = [r for r in corpus(5, 100) if r[0] is not None] + near(3, 4, 6, 80) + [(1, None) for _ in range(0)]
    rows = list({i: (i, t) for i, t in rows}.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(OP12).fetchall(), key=str) == brute(rows)


@pytest.mark.parametrize("plan", [None, (1, 1, 1), (8, 1, 1), (2, 4, 8), (16, 2, 2)])
def test_totals(spark, plan):
    rng = random.Random(1)
    rows = [(i, ",".join(str(rng.choice([7, i, rng.randrange(400)])) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)

    def numbers(batch):
        found = [int(x) for text in batch.column("text").to_pylist() for x in text.split(",") if x]
        return np.unique(np.array(found, np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_counts=True)

    def tell(batches):
        for rows in batches:
            for payload, answers in zip(rows.column("payload"), rows.column("answers")):
                keys, _ = numbers(tables.unpack(payload.as_buffer()))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "total": pa.array(totals_of(answers.as_py()).astype(np.int64))})

    blocks = tables.packed_blocks(docs, "id", "text", limit=400)
    out = with_totals(blocks, numbers, plan=plan)
    told = tables.in_arrow(out.select("payload", "answers"), tell, "key long, total long").groupBy("key").agg(F.collect_set("total").alias("t"), F.count("*").alias("n")).collect()
    expected = Counter(int(x) for _, text in rows for x in text.split(",") if x)
    signed = {int(np.uint64(k * 0x9E3779B97F4A7C15 % 2**64).view(np.int64)): min(v, 255) for k, v in expected.items()}
    assert {r["key"]: r["t"] for r in told} == {k: [v] for k, v in signed.items()}
    assert max(r["n"] for r in told) > 20


def test_layout_is_bounded():
    """At most 1,024 messages a block at any size, and parts that fit a task."""
    for total in (0, 10**6, 3 * 10**10, 10**13, 10**14):
        routes, buckets, subs = layout(total, 200, 0.5)
        assert routes <= 1024 and subs <= 1024 and total * 0.5 / routes / buckets <= 64 << 20
