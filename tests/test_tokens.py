import random
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import apply
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gistmill import fixed_values as fx
from gistmill.functions import arrays, chat, wordtable
from gistmill.operators import lookup
from gistmill.operators import predict as p
from gistmill.operators import tokens as tok
from gistmill.operators.ordering import assign_batches, rank_rows
from gistmill.plans.flows import training_batches
from gistmill.session import materialize
from gistmill.sources import runs as run_io

# the factories below are not importable on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXTS = ["b a b", "c  a\tb", "", "zz", "a " * 40]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(TEXTS)], "split string, id long, text string")


@pytest.fixture(scope="module")
def vocab(texts):
    return tok.vocabulary(texts, "text")


def expected_ids():
    counts = Counter(w for t in TEXTS for w in t.split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    return {w: i + tok.RESERVED for i, w in enumerate(order)}


def test_vocabulary(vocab):
    assert {r.token: r.token_id for r in vocab.collect()} == expected_ids()


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
@pytest.mark.parametrize("max_length", [None, 2, 1000])
def test_encode_by_broadcast_and_by_shuffle(texts, vocab, broadcast_bytes, max_length):
    encoded = tok.encode(texts, "text", vocab, ["split", "id"], max_length, broadcast_bytes=broadcast_bytes)
    ids = expected_ids()
    assert {r.id: r.input_ids for r in encoded.collect()} == {
        i: [ids[w] for w in t.split()][:max_length] for i, t in enumerate(TEXTS)
    }


def test_frequent_keys_never_reach_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_KEYS", 10)
    words = ["the"] * 50 + ["gone"] * 40 + ["a", "b", "c", "d", None]
    rows = materialize(spark.createDataFrame(list(enumerate(words)), "i long, w string"))
    table = materialize(spark.createDataFrame([("the", 1), ("a", 2), ("d", 3)], "w string, v int"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = lookup.frequent_lookup(rows, table, "w")
        values = {"the": 1, "a": 2, "d": 3}
        assert sorted((r.i, r.v) for r in found.collect()) == [(i, values.get(w)) for i, w in enumerate(words)]
        shuffled = [
            line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(w" in line
        ]
        tail = rows.filter("w is not null").join(spark.createDataFrame([("the",), ("gone",)], "w string"), "w", "left_anti")
        assert len(shuffled) >= 2 and tail.count() == 4
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and "broadcast" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_large_ids_and_repeated_keys(spark, broadcast_bytes):
    """Rows of the same keys are encoded each for itself, and ids need not be small."""
    vocab = spark.createDataFrame([("a", 1, 3_000_000_000), ("b", 1, 5)], "token string, n long, token_id long")
    rows = [(1, "a b"), (2, ""), (3, None), (4, "a b"), (4, "b"), (4, "b"), (5, ""), (5, "b a b"), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "int int, text string").withColumnRenamed("int", "id")
    got = sorted((r.id, r.input_ids) for r in tok.encode(df, "text", vocab, ["id"], broadcast_bytes=broadcast_bytes).collect())
    ids = {"a": 3_000_000_000, "b": 5}
    assert got == sorted((i, [ids[w] for w in (t or "").split()]) for i, t in rows)


def test_ids_beyond_the_shuffles_numbers(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    wide = spark.createDataFrame([("a", 1, 1 << 40)], "token string, n long, token_id long")
    assert tok.encode(df, "text", wide, ["id"]).first().input_ids == [1 << 40, tok.UNKNOWN_ID]
    with pytest.raises(Exception, match="too large"):
        tok.encode(df, "text", wide, ["id"], broadcast_bytes=-1).collect()


def test_shuffled_encoding_moves_a_word_once_a_block(spark, monkeypatch):
    """Texts of one word each a hundred times over move as many words as blocks have distinct ones, not as they have places."""
    rows = [(k % 5, " ".join(["the", f"w{k % 7}"] * 100) if k % 11 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    vocab = spark.createDataFrame([("the", 2), ("w1", 3), ("w2", 1 << 35), ("w6", 4)], "token string, token_id long")
    numbers, written = {"the": 2, "w1": 3, "w2": 1 << 35, "w6": 4}, []
    monkeypatch.setattr(tok, "BLOCK_ROWS", 8, raising=False)
    monkeypatch.setattr(tok, "materialize", lambda df: written.append(materialize(df)) or written[-1], raising=False)
    encoded = tok.encode(df, "text", vocab, ["id"], 150, broadcast_bytes=-1)
    assert sorted((r.id, r.input_ids) for r in encoded.collect()) == sorted((i, [numbers.get(w, tok.UNKNOWN_ID) for w in (t or "").split()[:150]]) for i, t in rows)
    (blocks,) = written
    assert blocks.filter("payload is not null").count() == 8 and blocks.filter("token is not null").count() <= 8 * 8
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_blocks_are_filled_from_many_batches_by_the_words_they_keep(spark, monkeypatch):
    """What is cut from long texts and where Arrow's batches end do not make blocks smaller: a word is asked for once."""
    rows = [(k, " ".join([f"w{k % 3}"] * 3 + ["x" * 50] * 40) if k % 7 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    vocab = spark.createDataFrame([(f"w{k}", k + 2) for k in range(3)], "token string, token_id long")
    written = []
    monkeypatch.setattr(tok, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(tok, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        encoded = tok.encode(df, "text", vocab, ["id"], 3, broadcast_bytes=-1)
        assert sorted((r.id, r.input_ids) for r in encoded.collect()) == [(k, [k % 3 + 2] * 3 if t else []) for k, t in rows]
        counted = {r.token: r.n for r in tok.vocabulary(df, "text").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert written[0].filter("payload is not null").count() == 1 and written[0].filter("token is not null").count() == 3
    assert counted == Counter(w for _, t in rows for w in (t or "").split())


def test_prompts_are_counted_without_a_regular_expression(spark, corpus, vocab):
    texts = [None, "", " \t", "a", *[f"{c}a{c}{c}b {c}" for c in re.findall(r"\s", "".join(map(chr, range(0x3001))))]] * 3
    assert apply(spark, wordtable.count_udf(), texts) == [None if t is None else len(t.split()) for t in texts]
    assert wordtable.count_words(pa.array(["x", "a b", None, ""]).slice(1)).to_pylist() == [2, None, 0]
    examples = tok.training_examples(corpus, vocab)
    assert "regexp" not in examples._jdf.queryExecution().optimizedPlan().toString().lower()
    lengths = {r.id: r.prompt_length for r in examples.collect()}
    prompts = corpus.select("id", chat.render_example(F.col("abstract")).alias("p")).collect()
    assert lengths == {r.id: len(r.p.split()) for r in prompts}


def test_rows_of_blocks_are_placed_without_texts_or_ids(spark, monkeypatch):
    """Left-padded batches in an order with repeated rows, empty and null texts: as by brute force, from blocks and by broadcast."""
    texts = {k: None if k % 13 == 5 else " ".join(f"w{(k * j) % 9}" for j in range(k % 6)) for k in range(40)}
    rows = [("ab"[k % 2], k, texts[k]) for k in range(40)] + [("b", k, texts[k]) for k in (7, 7, 11)]
    df = spark.createDataFrame(rows, "split string, pos int, text string").repartition(3)
    vocab = spark.createDataFrame([(f"w{k}", k + 2) for k in range(8)], "token string, token_id long")
    seen = []

    def place(rows, length):
        seen.append(set(rows.columns))
        return tok.with_longest(assign_batches(rank_rows(rows, [F.col("pos")], by=["split"]), 4), length)

    expected = []
    for split in "ab":
        own = sorted((k, [int(w[1:]) + 2 if w != "w8" else tok.UNKNOWN_ID for w in (t or "").split()[:4]]) for s, k, t in rows if s == split)
        for first in range(0, len(own), 4):
            longest = max(len(ids) for _, ids in own[first:first + 4])
            expected += [(split, first + i + 1, k, [0] * (longest - len(ids)) + ids) for i, (k, ids) in enumerate(own[first:first + 4])]
    monkeypatch.setattr(tok, "BLOCK_ROWS", 5)
    for limit in (-1, 1 << 20):
        encoded = tok.encode(df, "text", vocab, ["split", "pos"], 4, broadcast_bytes=limit, place=place)
        found = tok.pad_batches(encoded, 0, left=True, longest="longest").collect()
        assert sorted((r.split, r.position, r.pos, r.input_ids) for r in found) == expected
        assert set(found[0].asDict()) == {"split", "pos", "position", "batch_id", "longest", "input_ids", "attention_mask"}
    assert not {"text", "_text", "input_ids"} & seen[0] and "input_ids" in seen[1]


@pytest.mark.parametrize("budget", [None, 150])
def test_training_batches_beyond_a_broadcast_do_not_sort_ids(corpus, monkeypatch, budget):
    """The same batches, and what is numbered and batched has no ids."""
    kinds = {}
    for fits in (True, False):
        monkeypatch.setattr(tok.lookup, "fits_broadcast", lambda *_, fits=fits: fits)
        kinds[fits] = training_batches(corpus, 0, max_length=50, token_budget=budget)
    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    windows = [x for x in nodes(kinds[False]._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "Window"]
    assert windows and not any("input_ids" in x.output().mkString(",") for x in windows)
    assert set(kinds[True].columns) == set(kinds[False].columns)
    was, now = (sorted((r.split, r.id, sorted(r.asDict().items())) for r in kinds[fits].collect()) for fits in (True, False))
    assert now == was and len(now) == 23


def test_broadcast_encoding_moves_and_explodes_nothing(spark, vocab):
    df = materialize(spark.createDataFrame([(1, "a b")], "id int, text string"))
    plan = tok.encode(df, "text", materialize(vocab), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    assert not any(node in plan for node in ("Exchange", "Generate", "Aggregate", "Join"))


def test_word_table(spark, monkeypatch):
    """Every word finds its number, others none, also where hashes agree; a first multiplier that makes words collide is left."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab\u00e9\u4f60") for _ in range(rng.randint(1, 9))) for _ in range(3000)} | {"x" * 70_000, "\0", "\0\0"})
    numbers = np.arange(len(words)) * 7
    table = wordtable.build(pa.array(words), numbers)
    asked = words[::-1] + ["nowhere", "", "x" * 69_999, "a\u00e9b" * 20]
    expected = [words.index(w) * 7 for w in words[::-1]] + [-1] * 4
    assert wordtable.find(pa.array(asked), table, -1).tolist() == expected
    # a hash that agrees without its bytes is no hit
    lone = wordtable.build(pa.array(["ab"]), [9])
    forged = (wordtable.hashes(np.frombuffer(b"bb", np.uint8), np.array([0, 2]), lone[4]), *lone[1:])
    assert wordtable.find(pa.array(["bb", "ab"]), forged, -1).tolist() == [-1, -1]
    true_hashes = wordtable.hashes
    monkeypatch.setattr(wordtable, "hashes", lambda d, c, m: true_hashes(d, c, m) // np.uint64(1 << 62) if m == wordtable._FIRST_MULTIPLIER else true_hashes(d, c, m))
    other = wordtable.build(pa.array(words), numbers)
    assert other[4] != wordtable._FIRST_MULTIPLIER and wordtable.find(pa.array(asked), other, -1).tolist() == expected
    with pytest.raises(ValueError, match="twice"):
        wordtable.build(pa.array(["a", "a"]), [1, 2])
    assert wordtable.find(pa.array([], pa.string()), table, 1).tolist() == [] and wordtable.find(pa.array(["a"]), wordtable.build(pa.array([], pa.string()), []), 1).tolist() == [1]


def test_words_of_any_text_are_split_at_the_same_characters():
    """Arrow's white space is Python's (and ours), each character of it."""
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    words, cuts = wordtable.split_text(pa.array(texts), None)
    assert words.to_pylist() == [w for t in texts for w in t.split()] and np.diff(cuts).tolist() == [len(t.split()) for t in texts]
    odd = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 4, 7], "<i4").tobytes()), pa.py_buffer(b"a \xff b c")])
    assert [x.to_pylist() if isinstance(x, pa.Array) else x.tolist() for x in wordtable.split_text(odd, 2)] == [["a", "\ufffd", "b", "c"], [0, 2, 4]]


def test_unknown_tokens(spark, vocab):
    df = spark.createDataFrame([(1, "a new b")], "id int, text string")
    ids = expected_ids()
    assert tok.encode(df, "text", vocab, ["id"]).first().input_ids == [ids["a"], tok.UNKNOWN_ID, ids["b"]]
    assert {tok.PAD_ID, tok.UNKNOWN_ID}.isdisjoint(ids.values())


def test_chat_messages(spark):
    df = spark.createDataFrame([("Some abstract text.", "Sum."), ("Other.", None)], "a string, s string")
    prompt = df.select(chat.chat_messages(F.col("a"))).first()[0]
    assert [m.role for m in prompt] == ["system", "user"]
    assert "Some abstract text." in prompt[1].content and "TL;DR" in prompt[1].content
    answered, open_ = [r[0] for r in df.select(chat.chat_messages(F.col("a"), F.col("s"))).collect()]
    assert [m.role for m in answered] == ["system", "user", "assistant"] and len(open_) == 2


def test_generation_header_only_without_summary(spark):
    df = spark.createDataFrame([("A.", "Sum."), ("A.", None)], "a string, s string")
    full, prompt = [r[0] for r in df.select(chat.render_example(F.col("a"), F.col("s"))).collect()]
    assert prompt.endswith("<|assistant|>\n") and full.startswith(prompt) and full.endswith("Sum.\n<|end|>\n")
    other = chat.ChatTemplate(header="[{role}] ", end_of_turn=" [/]\n")
    text = df.select(chat.render_example(F.col("a"), F.col("s"), other)).first()[0]
    assert text.endswith("Write the TL;DR. [/]\n[assistant] Sum. [/]\n")


def test_completion_labels(spark):
    def labels(prompt_length):
        return lambda c: arrays.completion_labels(c, F.lit(prompt_length))

    assert apply(spark, labels(2), [[5, 6, 7, 8]], "array<int>") == [[-100, -100, 7, 8]]
    assert apply(spark, labels(0), [[5, 6]], "array<int>") == [[5, 6]]
    assert apply(spark, labels(9), [[5, 6]], "array<int>") == [[-100, -100]]


def padded(spark, rows, left=False):
    df = spark.createDataFrame(rows, "split string, batch_id long, i int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    return sorted(tok.pad_batches(df, 0, left=left).collect(), key=lambda r: r.i), tok.pad_batches(df, 0).dtypes


def test_padding(spark):
    rows, types = padded(spark, [
        ("t", 0, 0, [31, 32, 33, 34], [1] * 4, [-100, -100, 33, 34]), ("t", 0, 1, [41], [1], [41]), ("t", 1, 2, [57, 58], [1, 1], [-100, 58]),
    ])
    assert rows[0].input_ids == [31, 32, 33, 34] and rows[1].input_ids == [41, 0, 0, 0]
    assert rows[1].attention_mask == [1, 0, 0, 0] and rows[1].labels == [41, -100, -100, -100]
    assert rows[2].input_ids == [57, 58]
    assert {t for n, t in types if n in ("input_ids", "attention_mask", "labels")} == {"array<bigint>"}


def test_equal_lengths_stay_as_they_are(spark):
    rows, _ = padded(spark, [("t", 5, 0, [71, 72, 73], [1] * 3, [71, 72, 73]), ("t", 5, 1, [81, 82, 83], [1] * 3, [-100, 82, 83])])
    assert [r.input_ids for r in rows] == [[71, 72, 73], [81, 82, 83]] and all(r.attention_mask == [1, 1, 1] for r in rows)


def test_left_padding(spark):
    df = spark.createDataFrame([("t", 0, 0, [91, 92]), ("t", 0, 1, [95, 96, 97, 98])], "split string, batch_id long, i int, input_ids array<long>")
    rows = sorted(tok.pad_batches(df, tok.PAD_ID, left=True).collect(), key=lambda r: r.i)
    assert rows[0].input_ids == [0, 0, 91, 92] and rows[0].attention_mask == [0, 0, 1, 1]
    assert rows[1].attention_mask == [1, 1, 1, 1]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        [("train", f"id{i}", "word " * (i % 7) + f"token{i}.", f"short answer {i}", "s") for i in range(23)],
        "split string, id string, abstract string, summary string, source string",
    )


def test_training_batches_invariants(corpus):
    rows = training_batches(corpus, pad_id=0, max_length=50).collect()
    assert len(rows) == 23
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels)
        real = sum(r.attention_mask)
        supervised = sum(x != fx.IGNORED_LABEL for x in r.labels)
        full_prompt = 45 + int(r.id[2:]) % 7
        assert supervised == max(0, real - full_prompt) or real == 50
        assert r.labels[real:] == [fx.IGNORED_LABEL] * (len(r.labels) - real)
    for batch in batches.values():
        assert len({len(r.input_ids) for r in batch}) == 1
    assert sorted(map(len, batches.values())) == [3, 4, 4, 4, 4, 4]


def test_texts_and_batches_take_one_shuffle_each(spark, corpus, vocab):
    query = training_batches(materialize(corpus), 0, materialize(vocab))._jdf.queryExecution()
    plan = query.executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert sum("batch_id" in line for line in shuffles) == 1
    assert len(shuffles) == 4  # numbering takes one, and the other two carry counted buckets only
    # what a shuffle brings is what stands right below it: ids are made where the texts are
    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    numbering = next(x for x in nodes(query.optimizedPlan()) if x.nodeName() == "Window" and "row_number" in x.toString().split("\n")[0])
    moved = {re.sub("#.*", "", x) for x in numbering.children().apply(0).output().mkString(",").split(",")}
    assert moved == {"split", "_bucket", "_key", "id", "prompt_length", "input_ids"}
    below = query.optimizedPlan().toString().split("\n")
    batches = next(line for line in below[next(i for i, x in enumerate(below) if "Window" in x and "batch_id" in x) + 1:] if "Project" in line)
    assert "input_ids" in batches and "labels" not in batches and "attention_mask" not in batches


def test_prompt_tokens_are_a_prefix(spark, corpus):
    rendered = corpus.select(
        "id",
        tok.text_tokens(chat.render_example(F.col("abstract"))).alias("p"),
        tok.text_tokens(chat.render_example(F.col("abstract"), F.col("summary"))).alias("f"),
    )
    assert all(r.f[: len(r.p)] == r.p for r in rendered.collect())


def char_tokenizer():
    return lambda text: [ord(c) for c in text]


def test_pluggable_tokenizer(corpus):
    examples = tok.training_examples(corpus, tokenize=tok.tokenizer_udf(char_tokenizer), max_length=10_000)
    row = examples.filter("id = 'id3'").first()
    answer = "".join(chr(x) for x in row.labels if x != fx.IGNORED_LABEL)
    assert answer == "short answer 3\n<|end|>\n"
    assert row.attention_mask == [1] * len(row.input_ids)


def counting_tokenizer():
    def tokenize(texts):
        assert None not in texts and 0 < len(texts) <= 3
        return [[len(texts), 1 << 40, *map(ord, text)] for text in texts]

    return tokenize


def test_list_tokenizer_gets_lists_without_nulls(spark):
    values = ["a", None, "bc", "", None, "d", "e"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").coalesce(1)
    ids = {r.i: r.ids for r in rows.select("i", tok.batch_tokenizer_udf(counting_tokenizer, rows=3)(F.col("x")).alias("ids")).collect()}
    assert ids == {
        0: [3, 1 << 40, 97], 1: None, 2: [3, 1 << 40, 98, 99], 3: [3, 1 << 40], 4: None, 5: [2, 1 << 40, 100], 6: [2, 1 << 40, 101],
    }


def test_list_tokenizer_must_answer_each_text(spark):
    short = tok.batch_tokenizer_udf(lambda: lambda texts: [[1]] * (len(texts) - 1))
    with pytest.raises(Exception, match="tokenizer returned"):
        spark.createDataFrame([("a",)], "x string").select(short(F.col("x"))).collect()


def test_token_budget_batches_invariants(corpus):
    plain = {r.id: r for r in training_batches(corpus, pad_id=0, max_length=50).collect()}
    rows = training_batches(corpus, pad_id=0, max_length=50, token_budget=150).collect()
    assert {r.id for r in rows} == set(plain)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
        n = sum(r.attention_mask)
        assert r.input_ids[:n] == plain[r.id].input_ids[:n] and r.labels[:n] == plain[r.id].labels[:n]
        assert r.input_ids[n:] == [0] * (len(r.input_ids) - n) and len(r.labels) == len(r.attention_mask) == len(r.input_ids)
    for batch in batches.values():
        longest = max(sum(r.attention_mask) for r in batch)
        assert {len(r.input_ids) for r in batch} == {longest} and longest * len(batch) <= 150


def test_prompt_longer_than_the_limit_leaves_nothing_to_learn(corpus):
    examples = tok.training_examples(corpus, tokenize=tok.tokenizer_udf(char_tokenizer), max_length=20)
    assert all(set(r.labels) == {fx.IGNORED_LABEL} and len(r.labels) == 20 for r in examples.collect())


def test_padding_id():
    assert tok.padding_id(None, 2) == 2 and tok.padding_id(0, 2) == 0


def shouting_model():
    sizes = []

    def complete(prompts, max_new_tokens):
        sizes.append(len(prompts))
        assert max(sizes) <= 4 and max_new_tokens == 96
        abstracts = [t.split("Abstract:\n")[1].split("\n\nWrite")[0] for t in prompts]
        return [f'Here\'s the TL;DR:\n"{a.upper()}"' for a in abstracts]

    return complete


def test_generation_is_batched_and_cleaned(corpus):
    done = p.generate(corpus, shouting_model)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.prediction) for r in done.collect()} == {(r.id, r.abstract.upper()) for r in corpus.collect()}


def test_predictions_are_attached_by_key(corpus):
    made = p.extractive(corpus).select("split", "id", "prediction").repartition(7)
    done = p.attach_predictions(corpus, made)
    assert {(r.id, r.prediction) for r in done.collect()} == {(r.id, f"{r.abstract}") for r in corpus.collect()}


@pytest.mark.parametrize("change", ["missing", "surplus", "repeated", "both repeated"])
def test_predictions_must_match_one_to_one(corpus, change):
    made = p.extractive(corpus).select("split", "id", "prediction")
    records = corpus
    if change == "missing":
        made = made.filter("id <> 'id3'")
    elif change == "surplus":
        records = corpus.filter("id <> 'id3'")
    else:
        made = made.unionByName(made.filter("id = 'id3'"))
        if change == "both repeated":
            records = corpus.unionByName(corpus.filter("id = 'id3'"))
    with pytest.raises(ValueError, match="length mismatch"):
        p.attach_predictions(records, made)


def test_generator_must_answer_every_prompt(corpus):
    with pytest.raises(Exception, match="length mismatch"):
        p.generate(corpus, lambda: (lambda prompts, n: prompts[1:])).collect()


def test_extractive(corpus):
    assert p.extractive(corpus).filter("id = 'id0'").first().prediction == "token0."


def test_batches_of_unsplit_rows(spark):
    df = spark.range(1, 8).withColumnRenamed("id", "position")
    assert [r.batch_id for r in assign_batches(df, 3).orderBy("position").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_bucketed_tables_join_without_a_shuffle(spark, corpus, tmp_path):
    def bucketed(df, name):
        return run_io.write_bucketed(df, f"bucketed_{name}", str(tmp_path / name), buckets=4)

    records = bucketed(corpus.select("split", "id", "summary"), "records")
    made = p.extractive(corpus).select("split", "id", "prediction")
    done = p.attach_bucketed(records, bucketed(made, "predictions"))
    assert {tuple(r) for r in done.collect()} == {(r.split, r.id, r.summary, r.abstract) for r in corpus.collect()}
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    for change, wrong in {
        "missing": made.filter("id <> 'id3'"), "surplus": made.unionByName(made.filter("id = 'id3'").withColumn("id", F.lit("other"))),
        "repeated": made.unionByName(made.filter("id = 'id3'")),
    }.items():
        bad = p.attach_bucketed(records, bucketed(wrong, change))
        for some in (bad, bad.select("id"), bad.select("prediction")):
            with pytest.raises(Exception, match="length mismatch"):
                some.collect()
    with pytest.raises(Exception, match="length mismatch"):
        p.attach_bucketed(bucketed(corpus.select("split", "id", "summary").unionByName(corpus.select("split", "id", "summary").limit(1)), "twice"), bucketed(made, "single")).collect()


def test_generation_goes_on_where_it_was_ended(spark, corpus, tmp_path):
    """A generator that dies half-way; the next call makes only what is missing."""
    calls = str(tmp_path / "calls")
    chunks = {r.id: r.c for r in corpus.select("id", F.pmod(F.xxhash64("split", "id"), F.lit(6)).alias("c")).collect()}
    victim = next(x for x in sorted(chunks) if chunks[x] == 3)

    def model(dies):
        def factory():
            def complete(prompts, max_new_tokens):
                with open(calls, "a") as out:
                    for text in prompts:
                        name = text.split("token")[1].split(".")[0]
                        if dies and f"id{name}" == victim:
                            raise RuntimeError("lost")
                        out.write(name + "\n")
                return [text.split("Abstract:\n")[1].split("\n\nWrite")[0].upper() for text in prompts]

            return complete

        return factory

    out = str(tmp_path / "made")
    with pytest.raises(Exception, match="lost"):
        p.generate_resumable(corpus, model(True), out, "r", chunks=6, batch_size=1)
    first = {r.id for r in spark.read.parquet(out).collect()}
    assert 0 < len(first) < 23 and victim not in first
    open(calls, "w").close()
    done = p.generate_resumable(corpus, model(False), out, "r", chunks=6, batch_size=1)
    assert {(r.id, r.prediction) for r in done.collect()} == {(r.id, r.abstract.upper()) for r in corpus.collect()}
    again = [f"id{x}" for x in open(calls).read().split()]
    assert sorted(again) == sorted({f"id{k}" for k in range(23)} - first)
    p.generate_resumable(corpus, model(False), out, "r", chunks=6)
    assert len(open(calls).read().split()) == len(again) and done.count() == 23
