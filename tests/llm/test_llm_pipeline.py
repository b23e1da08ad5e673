"""The pipeline's stages one after another, and the registered queries."""

import random

import brute
import duckdb
import public_tokenizers
import pytest
from cases import corpus, vocabulary
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from gistmill.llm.tables import packed_blocks

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = vocabulary(rng, 200)
    rows = corpus(7, 250)
    toxic = {i for i in range(300, 400)}
    rows += [(i, " ".join(rng.choices(words, k=20) + ["scornevil" + rng.choice("aeiou") * 2]) if i in toxic else " ".join(rng.choices(words, k=40))) for i in range(300, 600)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", "s", len(t)) for i, t in rows] + [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, toxic


def test_each_stage_against_brute_force(spark, folder):
    path, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    read = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()))
    before = read(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if name == "packing":
            break
        assert docs.columns == COLUMNS
        docs = corpus_pipeline.stored(docs)
        assert docs.filter("n_chars <> char_length(text) or (n_chars is null) <> (text is null)").isEmpty()
        after = read(docs)
        if name == "toxicity":
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 5
            assert set(after) <= set(before)
        elif name == "line_dedup":
            assert after == sorted((i, t) for i, _, _, t in brute.lines(before)) and after != before
        elif name == "near_dedup":
            kept = {i for i, _, _, k in brute.near_components(before) if k}
            assert after == [x for x in before if x[0] in kept] and after != before
        else:
            assert after == sorted((i, t) for i, _, _, _, t in brute.substrings(before, 13)) and after != before
        before = after
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = docs.groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, got)) == [(i, 1 + len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in before]
    whole = corpus_pipeline.run(spark, path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(names).collect())) == sorted(map(tuple, docs.select(names).collect()))


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", [x for x in __spark_entry__.oracle_sql() if x.startswith("op")])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    expected = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(map(tuple, got.select(expected.columns).collect()), key=str) == sorted(expected.fetchall(), key=str)


def test_contract_columns(spark):
    expected = {
        "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op2_quality": ["doc_id", "held_out", "score", "predicted"],
        "op3_fertility": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op6_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
        "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op9_main_text": ["page_id", "url", "text", "n_chars"],
    }
    for name, columns in expected.items():
        found = __spark_entry__.queries()[name](spark, SMALL)
        assert set(columns) <= set(found.columns)
        table = "pages" if name.startswith("op9") else "documents"
        assert found.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score string, N_LINES string, kept string, row string, `rep` int"


def awkward_tables(spark, path, labels):
    words = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    rows = [(i, t) for i, t in enumerate(words)] + [(2, words[2]), (2, words[2]), (9, words[0]), (10, None), (None, "x y"), (None, words[1]), (11, ""), (12, "z " * 30_000)]
    docs = [(i, t, "en", None, None if t is None else len(t), "s", "n", f"k{i}", None, 7) for i, t in rows]
    spark.createDataFrame(docs, AWKWARD).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


@pytest.mark.parametrize("labels", [[], [(0, 1, 1), (1, 1, 1)], [(0, 1, 0), (None, 1, 1), (77, 0, 1)]])
def test_pipeline_keeps_the_corpus_without_usable_labels(spark, tmp_path, labels):
    """No labels, labels of one kind, labels without their documents; null and repeated ids, clashing and extra columns."""
    rows = awkward_tables(spark, str(tmp_path), labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: str(tuple(r))
    first = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    assert sorted(map(key, first.collect())) == sorted(map(key, rows))


def test_stages_on_awkward_rows(spark, tmp_path):
    rows = awkward_tables(spark, str(tmp_path), [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names
        found = sorted((str(r.doc_id), r.text, r.kept, r.score, r.n_chars) for r in out.collect() if r.text is not None)
        assert all(len(r[1]) == r[4] for r in found)
        kept = [r for r in rows if r[0] not in (9, None)] if name == "near_dedup" else rows
        assert [r[0] for r in found] == sorted(str(r[0]) for r in kept if r[1] is not None)
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.isEmpty()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.groupBy("doc_id").count().count() == 9  # not 9, nor the null id, which is near 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).isEmpty()


@pytest.mark.parametrize("changed", [True, False])
def test_stages_carry_a_text_once(spark, changed):
    """What an operator packs and shuffles holds each id and text once, and other columns under any name."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "".join(rng.choices(letters, k=2_000)), "en", 2_000, f"r{i}") for i in range(200)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, _row string")
    weight = lambda df: packed_blocks(df, "doc_id", "text").agg(F.sum(F.length("payload"))).first()[0]
    weights = []

    def operator(df):
        weights.append(weight(df))
        return df.withColumn("text", F.upper("text")) if changed else df

    for columns in (docs.columns, ["text", "doc_id"]):
        some = docs.select(columns)
        out = corpus_pipeline._applied(operator, some, changed)
        assert out.dtypes == some.dtypes
        expected = some.withColumn("text", F.upper("text")) if changed else some
        assert sorted(map(str, out.collect())) == sorted(map(str, expected.collect()))
    plain = weight(docs.select("doc_id", "text"))
    assert plain > 200_000 and max(weights) < 1.2 * plain


ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.driver.memory", "2g").config("spark.sql.warehouse.dir", "warehouse").getOrCreate()
import __spark_entry__
q = __spark_entry__.queries()
for name in {names!r}:
    assert q[name](spark, {data!r}).count() > 0, name
print("all done")
"""


def test_functions_travel_by_value(tmp_path):
    """Workers that can't import the package: another working directory, no PYTHONPATH."""
    import os
    import subprocess
    import sys

    names = ["op3_fertility", "op4_bpe", "op5_packing", "op11_prefix_trie", "op13_whitening", "encode", "rouge_l", "embedding_f1"]
    code = ELSEWHERE.format(root=os.path.dirname(os.path.abspath(__spark_entry__.__file__)), names=names, data=SMALL)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.path.dirname(public_tokenizers.__file__) if "site-packages" not in public_tokenizers.__file__ else ""}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in done.stdout, done.stderr[-3000:]
