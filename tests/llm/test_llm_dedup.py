"""Substring, line and near-duplicate removal against brute force."""

import json
import sys
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, corpus, frame, kept_columns
from pyspark import cloudpickle

from gistmill.llm import substring_dedup as sd
from gistmill.llm import tables
from gistmill.llm.line_dedup import line_dedup
from gistmill.llm.near_dedup import components, near_duplicates
from gistmill.llm.substring_dedup import substring_dedup

# functions below are not importable on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("window", [2, 7, 13])
def test_substrings(spark, window):
    rows = corpus() + awkward()
    docs = frame(spark, rows)
    found = substring_dedup(docs, window)
    got = sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256", "text").collect()), key=str)
    assert got == sorted(brute.substrings(rows, window), key=str)
    assert sum(x[2] for x in got) > 100
    kept_columns(docs, found, {"text", "n_words", "n_removed", "kept_sha256"})


def test_substrings_of_nothing(spark):
    found = substring_dedup(frame(spark, []), keep_text=False)
    assert found.collect() == [] and "text" not in found.columns


def test_lines(spark):
    rows = corpus() + awkward() + [(2000 + i, "Same  line that is long enough to be counted, really.\nown") for i in range(6)]
    docs = frame(spark, rows)
    found = line_dedup(docs)
    got = list(map(tuple, found.select("doc_id", "n_lines", "n_dropped", "text").collect()))
    assert sorted(got, key=str) == sorted(brute.lines(rows), key=str)
    assert sum(x[2] for x in got) > 10
    kept_columns(docs, found, {"text", "n_lines", "n_dropped"})


def test_lines_of_nothing(spark):
    assert line_dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("partitions, step", [(1, 1), (4, -1)])
def test_near_duplicates(spark, partitions, step):
    rows = corpus(5, 200) + awkward()
    got = {tuple(r) for r in near_duplicates(frame(spark, rows[::step], partitions)).collect()}
    assert got == brute.near_components(rows)
    assert sum(not r[3] for r in got) > 40


def test_rows_of_one_id_link_what_they_are_near(spark):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "pq"]
    rows = [(1, texts[0]), (2, texts[1]), (5, texts[0]), (5, texts[1]), (5, None), (7, texts[0] + " more"), (None, texts[1]), (None, "alone it is")]
    for some in (rows, rows[::-1]):
        got = {tuple(r) for r in near_duplicates(frame(spark, some, 3)).collect()}
        assert got == brute.near_components(rows)
        assert {r[2] for r in got if r[1]} == {1}


def test_chain_without_a_common_center(spark):
    """Each text is close to the next only; all are one component."""
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(base[4 * i:4 * i + 60])) for i in range(10)]
    got = {tuple(r) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_components(rows)
    assert {r[2] for r in got} == {0}


def test_near_duplicates_of_nothing(spark):
    found = near_duplicates(frame(spark, []))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found.collect() == []
    assert {r.component_id for r in near_duplicates(frame(spark, [(1, None), (2, "")])).collect()} == {1, 2}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def _rounds(texts, count=8):
    """Both rounds over blocks of one text each, without Spark: the bodies asked in each, and which words repeat."""
    blocks = [sd._Windows(pa.record_batch({"id": pa.array([i], pa.int64()), "text": [t]}), "id", "text", 13, count) for i, t in enumerate(texts)]

    def ask(questions, settle):
        answers = [[] for _ in blocks]
        for part in range(count):
            askers = [k for k, q in enumerate(questions) if q[part]]
            if askers:
                for k, answer in zip(askers, settle(np.array(askers), [questions[k][part] for k in askers])):
                    answers[k].append({"part": part, "answer": answer})
        return answers

    def every_part(asked):
        assert all(body for _, body in asked) and [part for part, _ in asked] == sorted({part for part, _ in asked})
        return [dict(asked).get(part, b"") for part in range(count)]

    first = [every_part(b.seed_questions()) for b in blocks]
    for block, known in zip(blocks, ask(first, sd._settle_seeds)):
        block.extend(known)
    second = [every_part(b.questions()) for b in blocks]
    return first, second, [b.repeated(a) for b, a in zip(blocks, ask(second, sd._settle))]


def _held_by(askers, bodies):
    """For each value of each asker, how many askers hold it, and the asker."""
    values = [np.frombuffer(b, np.int64) for b in bodies]
    held = Counter(np.concatenate(values).tolist())
    return [json.dumps([int(asker), *[held[v] for v in x.tolist()]]).encode() for asker, x in zip(askers, values)]


@pytest.mark.parametrize("routes, part_bytes", [(7, 1), (7, 32 << 20), (50, 8 << 20), (999, 3 << 20)])
def test_routes_bring_what_parts_say_to_who_asked(spark, routes, part_bytes):
    count = 1000
    docs = spark.createDataFrame([(i, " ".join(str((i * k) ** 2 % 4001) for k in range(1, 40))) for i in range(120)] + [(500, None), (501, "")], "doc_id long, text string")
    blocks = tables.packed_blocks(docs.repartition(5), "doc_id", "text", limit=400)

    def emit(batch):
        values = np.unique([int(x) for text in batch.column("text").to_pylist() for x in (text or "").split()]).astype(np.int64)
        order, cuts = tables.deal(values * 7919 % count, count)
        return tables.dealt_bodies(lambda a, b: values[order][a:b].tobytes(), cuts)

    def told(routes):
        rows = tables.exchange_blocks(blocks, count, emit, _held_by, part_bytes=part_bytes, routes=routes).select("block", "answers").collect()
        return {r.block: {x.part: json.loads(bytes(x.answer)) for x in r.answers or []} for r in rows}

    direct = told(count)
    assert told(routes) == direct and len(direct) > 20
    assert all(answer[0] == block for block, answers in direct.items() for answer in answers.values())
    assert max(n for answers in direct.values() for answer in answers.values() for n in answer[1:]) > 10


@pytest.mark.parametrize("operator", ["substring", "near"])
def test_many_parts_give_the_same_result(spark, monkeypatch, operator):
    rows = corpus() + awkward()
    monkeypatch.setattr(tables, "parts_for", lambda *_, **__: 5_000)
    if operator == "substring":
        found = substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256", "text").collect()
        assert sorted(map(tuple, found), key=str) == sorted(brute.substrings(rows, 13), key=str)
    else:
        assert {tuple(r) for r in near_duplicates(frame(spark, rows)).collect()} == brute.near_components(rows)


def test_a_block_sends_few_messages_whatever_the_parts():
    text = " ".join(f"w{k}" for k in range(40_000))
    block = sd._Windows(pa.record_batch({"id": pa.array([1], pa.int64()), "text": [text]}), "id", "text", 13, 100_000)
    parts = [part for part, _ in block.seed_questions()]
    subs = -(-100_000 // tables.ROUTES)
    assert len(parts) > 4 * tables.ROUTES and len({part // subs for part in parts}) <= tables.ROUTES


def test_a_hot_seed_goes_to_many_parts():
    passage = " ".join(f"s{k}" for k in range(12))
    texts = [" ".join(f"{i}a{k}" for k in range(6)) + f" {passage} " + " ".join(f"{i}b{k}" for k in range(6)) for i in range(300)]
    first, second, lost = _rounds(texts)
    windows = [sum(len(q[part]) > 0 for q in second) for part in range(8)]
    # each text has twelve windows, all different; many share a seed
    assert sum(len(b) for q in first for b in q) <= 5 * 12 * 300
    assert max(sum(len(q[part]) for q in second) for part in range(8)) < 0.25 * sum(len(b) for q in second for b in q) and min(windows) > 0
    assert not any(x.any() for x in lost)


def test_windows_whose_seed_occurs_once_are_not_sent():
    texts = [" ".join(f"{i}w{k}" for k in range(40)) for i in range(3)]
    assert not any(b for q in _rounds(texts)[1] for b in q)
    assert [x.all() for x in _rounds([texts[0]] * 2)[2]] == [False, True]


def test_hashes_that_agree_in_40_bits(monkeypatch):
    plain = sd.joined_hash
    monkeypatch.setattr(sd, "joined_hash", lambda a, b: plain(a, b) & ~np.uint64((1 << 40) - 1))
    passage = " ".join(f"s{k}" for k in range(12))
    texts = [" ".join(f"{i}a{k}" for k in range(6)) + f" {passage} " + " ".join(f"{i}b{k}" for k in range(6)) for i in range(50)]
    _, second, lost = _rounds(texts)
    assert any(b for q in second for b in q) and not any(x.any() for x in lost)
    monkeypatch.setattr(sd, "joined_hash", lambda a, b: plain(a, b) >> np.uint64(54) << np.uint64(33))
    assert sum(x.sum() for x in _rounds(texts)[2]) == 0
