"""Encoding, packing and fertility rules against the libraries and brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from cases import awkward, corpus, frame, kept_columns, words
from tokenizers import Tokenizer

from gistmill.llm.bpe import BytePairs, WordCache, encode_digests, encode_texts
from gistmill.llm.fertility import fertility_rules
from gistmill.llm.packing import _best_fit, pack_sequences, plan_sequences
from gistmill.llm.words import Words, text_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(11)
    pool = [
        "a", "B", "aa", "'s", "'LL", "don't", "é", "É", "é", "İ", "ΣΑΣ", "ς", "ß", "\x1c", "\xa0", " ", "\x85", "١", "²", "\U0001f600",
        "日本", "한글", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "​", "\x00", "ﬁ", "!!", "...", "_", "12345", "Å", "\n", "\t", "  ",
        "x" * 40, "ab" * 30, "Ᲊ", "꟎", "\U00018e86",
    ]
    return ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(3000)]


def test_ids_and_texts_equal_the_library(library):
    texts = odd_texts()
    pairs = BytePairs(PATH)
    ids, cuts = WordCache(pairs.encode_words, most=500).ids(Words(*text_bytes(pa.array(texts))))
    for text, found, a, b in zip(texts, library.encode_batch(texts, add_special_tokens=False), cuts[:-1], cuts[1:]):
        assert found.ids == ids[a:b].tolist(), text
        assert library.decode(found.ids, skip_special_tokens=False) == pairs.decode(ids[a:b])


def test_encode_query(spark, library):
    rows = corpus() + awkward()
    docs = frame(spark, rows)
    found = encode_texts(docs, PATH, decoded=True)
    expected = sorted(((i, (e := library.encode(t or "", add_special_tokens=False).ids), library.decode(e, skip_special_tokens=False)) for i, t in rows), key=str)
    assert sorted(map(tuple, found.select("doc_id", "ids", "decoded").collect()), key=str) == expected
    kept_columns(docs, found, {"ids", "decoded"})
    digests = encode_digests(docs.select("doc_id", "text"), PATH)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert sorted(map(tuple, digests.collect()), key=str) == sorted(
        ((i, len(e), sha(np.array(e, "<u4").tobytes()), sha(d.encode())) for i, e, d in expected), key=str
    )
    assert encode_texts(frame(spark, []), PATH).collect() == []


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, library, capacity):
    rows = corpus() + awkward()
    found = pack_sequences(frame(spark, rows), PATH, capacity)
    got = [tuple(r) for r in found.collect()]
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            piece = ids[k:k + capacity]
            expected.append((i, k // capacity, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted((r[:5] for r in got), key=str) == sorted(expected, key=str)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    least = math.ceil(sum(r[3] for r in expected) / capacity)
    assert len(sequences) <= 1.05 * least + 1


def test_packing_of_nothing(spark):
    assert pack_sequences(frame(spark, []), PATH).collect() == []
    assert [tuple(r)[3:4] for r in pack_sequences(frame(spark, [(1, None)]), PATH).collect()] == [(1,)]


def _used(plan, capacity):
    used = np.zeros(capacity + 1, int)
    for content, times in plan:
        assert sum(x * k for x, k in content) <= capacity and times > 0
        for x, k in content:
            used[x] += k * times
    return used


@pytest.mark.parametrize("times", [1, 40, 10_000_000])
def test_plans_use_every_piece_and_come_near_the_bound(times):
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 200, 3000), rng.choice([60, 70, 90, 130], 3000), np.full(5000, 67), np.array([200, 1, 199])):
        counts = np.bincount(lengths, minlength=201) * times
        plan, bound = plan_sequences(counts, 200)
        assert (_used(plan, 200) == counts).all()
        n = sum(times for _, times in plan)
        assert bound <= n <= 1.03 * bound + 2


def _one_by_one(counts, capacity):
    """Rooms left by best fit of single pieces, longest first."""
    rooms = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(counts[length]):
            fitting = [room for room in rooms if room >= length]
            if fitting:
                rooms.remove(min(fitting))
            rooms.append(min(fitting, default=capacity) - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_of_groups_equals_best_fit_of_single_pieces(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 80))
    counts = np.bincount(rng.integers(1, capacity + 1, 150) if seed % 2 else rng.choice(rng.integers(1, capacity + 1, 4), 150), minlength=capacity + 1)
    plan = _best_fit(counts, capacity)
    assert (_used(plan, capacity) == counts).all()
    assert sorted(capacity - sum(x * k for x, k in content) for content, times in plan for _ in range(times)) == _one_by_one(counts, capacity)
    more = _best_fit(counts * 10**9, capacity)
    assert (_used(more, capacity) == counts * 10**9).all() and len(more) < 1000


def test_a_plan_never_loses_to_best_fit():
    for seed in range(6):
        counts = np.bincount(np.random.default_rng(seed).integers(30, 70, 400), minlength=101)
        assert sum(t for _, t in plan_sequences(counts, 100)[0]) <= sum(t for _, t in _best_fit(counts, 100))


def test_bound_is_exact_where_two_pieces_fit():
    counts = np.bincount([67] * 30, minlength=101)
    plan, bound = plan_sequences(counts, 100)
    assert (sum(t for _, t in plan), bound) == (30, 30)


def brute_measures(text, model):
    text = text or ""
    found = words(text)
    windows = Counter(tuple(found[k:k + 5]) for k in range(len(found) - 4))
    covered = set()
    for k in range(len(found) - 4):
        if windows[tuple(found[k:k + 5])] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in text.split("\n") if words(x)]
    ids = [i for w in found for i in model.encode(w)]
    n = len(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0
    return (
        len(found), sum(map(len, found)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered),
        n, sum(map(len, found)) / max(n, 1), sum(model.is_byte(i) for i in ids) / max(n, 1), entropy,
    )


def test_fertility(spark):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choices("the of and water stone river house light people small green".split(), k=60) + [f"w{i}"])) for i in range(3000, 3060)]
    junk = [(i, " ".join(w + "$$$" for w in rng.choices("the of and water".split(), k=60)) + f" {i}") for i in range(4000, 4003)]
    lines = [(5000, "a b\n\n a b\na b\nc\na b"), (5001, "a b c d e f g h i j k a b c d e x y z")]
    rows = corpus() + awkward() + good + junk + lines
    docs = frame(spark, rows)
    found = fertility_rules(docs, PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy"]
    rounded = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    got = sorted((rounded(r) for r in found.select("doc_id", *names, "base_failed").collect()), key=str)
    expected = []
    for i, text in rows:
        m = brute_measures(text, model)
        expected.append(rounded((i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])))
    assert got == sorted(expected, key=str)
    verdict = {r.doc_id: r.kept for r in found.select("doc_id", "kept").collect()}
    assert all(verdict[i] for i, _ in good)
    assert not any(r.kept for r in found.filter("base_failed").collect())
    kept_columns(docs, found.withColumn("text", found.doc_id.cast("string")), {"text", "script", "base_failed", "kept", *names})
    assert fertility_rules(frame(spark, []), PIECES).collect() == []


def test_fertility_rejects_what_leaves_its_band(spark):
    rng = random.Random(6)
    plain = "when people walk along the river in summer they see green trees and small houses near old stone bridges".split()
    rows = [(i, " ".join(rng.choices(plain, k=200))) for i in range(60)]
    rows += [(100 + i, " ".join(w + rng.choice(["***", "$$$"]) for w in rng.choices(plain[:3], k=70))) for i in range(3)]
    found = {r.doc_id: r.kept for r in fertility_rules(frame(spark, rows), PIECES, language_column=None).filter("not base_failed").collect()}
    assert all(kept for i, kept in found.items() if i < 100)
    assert not any(kept for i, kept in found.items() if i >= 100)


def _prose(rng, count, first, size=200):
    plain = "when people walk along the river in summer they see green trees and small houses near old stone bridges".split()
    return [(first + i, " ".join(rng.choices(plain, k=size) + [f"w{rng.random()}"])) for i in range(count)]


def _kept(spark, rows, lang="en"):
    docs = spark.createDataFrame([(i, t, lang) for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    found = fertility_rules(docs, PIECES)
    assert found.filter("base_failed").count() == 0
    return {r.doc_id: r.kept for r in found.select("doc_id", "kept").collect()}


def test_fertility_rejects_a_third_of_a_band(spark):
    rng = random.Random(7)
    symbols = [(1000 + i, " ".join(w + rng.choice(["*", "$"]) for w in rng.choices("when they see the old green trees".split(), k=90)) + f" {i}") for i in range(40)]
    found = _kept(spark, _prose(rng, 80, 0) + symbols)
    assert all(kept for i, kept in found.items() if i < 1000)
    assert not any(kept for i, kept in found.items() if i >= 1000)


def test_fertility_judges_texts_alone_in_their_band(spark):
    rng = random.Random(8)
    long = " ".join(w + rng.choice(["*", "$"]) for w in rng.choices("when they see the old green trees".split(), k=5000))
    digits = " ".join(str(rng.randrange(10, 100)) for _ in range(150))
    found = _kept(spark, _prose(rng, 60, 0) + _prose(rng, 1, 100, 5000) + [(1000, long), (1001, digits)])
    assert all(kept for i, kept in found.items() if i < 1000) and not found[1000] and not found[1001]
    # without anything to compare with
    assert _kept(spark, [(1, digits)]) == {1: False} and _kept(spark, _prose(rng, 1, 2)) == {2: True}


def test_fertility_is_alike_in_a_larger_corpus(spark):
    """The same kinds of texts are judged alike whether a band has few or many of them, and a corpus put in twice changes nothing."""
    rng = random.Random(10)
    junk = [(1000 + i, " ".join(w + rng.choice(["*", "$"]) for w in rng.choices("when they see the old green trees".split(), k=90)) + f" {i}") for i in range(2)]
    for count in (8, 12, 19, 20, 21, 40):
        rows = _prose(rng, count, 0) + junk
        found = _kept(spark, rows)
        assert found == {i: i < 1000 for i, _ in rows}
        twice = _kept(spark, rows + [(i + 5000, t) for i, t in rows])
        assert all(twice[i] == twice[i + 5000] == found[i] for i, _ in rows)


def test_fertility_keeps_scripts_and_copies(spark):
    rng = random.Random(9)
    cyrillic = "когда люди идут вдоль реки летом они видят зелёные деревья и маленькие дома около старых каменных мостов".split()
    tifinagh = "ⵜⴰⵎⴰⵣⵉⵖⵜ ⵜⵓⵜⵍⴰⵢⵜ ⵏ ⵉⵎⴰⵣⵉⵖⵏ ⴳ ⵜⵎⴰⵣⵖⴰ".split()
    rows = _prose(rng, 40, 0) + [(100 + i, " ".join(rng.choices(cyrillic, k=150))) for i in range(30)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]
    assert all(_kept(spark, rows, None).values())
    assert _kept(spark, [(i, " ".join(rng.choices(tifinagh, k=60))) for i in range(5)], "ber") == dict.fromkeys(range(5), True)
