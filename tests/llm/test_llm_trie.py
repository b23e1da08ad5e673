"""The prefix trie against a recursive one in plain Python, and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from cases import words
from pyspark.sql import types as T

from gistmill.llm import prefix_trie
from gistmill.llm.oracles import OP11
from gistmill.llm.prefix_trie import SpillingQueue, conversation_trie
from gistmill.llm.prefix_trie import prefix_trie as trie_of

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("depth", "words", "key", "x1", "N_CONVS", "band", "position", "h1", "_h", "saved")]
)


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, *"abcdefghij") for r in rows], SCHEMA).repartition(partitions)


def rebuilt(rows):
    """{id: turns} from rows (id, turn, role, text) without ties."""
    convs = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    if not convs:
        return []
    members, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in children.get(path, [])) or 1
        own = (len(members[path]) - 1) * (len(words(path[-1][1])) if path else 0)
        saved[path] = own + sum(saved[p] for p in children.get(path, []))
    out = []
    for path, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(path))
        out.append((
            min(held), len(path), min(members[path[:-1]]) if path else None, len(held), len(children.get(path, [])),
            leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[0], r[1]))


def found(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=lambda r: (r[0], r[1]))


def shared(seed, size=150):
    """Conversations that share turns, some whole; awkward ids, turns, roles and texts."""
    rng = random.Random(seed)
    said = [" ".join(rng.choices(["a", "b", "\xa0", "new", "É", ""], k=rng.randint(0, 6))) for _ in range(3)]
    rows = []
    for c in [*range(size), 1000, 1019, -5, -20, -40, 2**62]:
        turns = rng.sample([None, *range(-2, 12)], rng.randint(1, 9))
        rows += [(c, t, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else "user", rng.choice([*said, None])) for t in turns]
    return rows + [(None, 1, "user", "x"), (None, None, None, None)]


@pytest.mark.parametrize("bounds,queue,band", [((1000, 10**6), 1 << 18, 4096), ((2, 9), 2, 3), ((1, 1), 1, 1), ((5,), 3, 2)])
def test_against_brute_force(spark, monkeypatch, bounds, queue, band):
    rows = shared(sum(bounds))
    monkeypatch.setattr(prefix_trie, "BAND", band)
    assert found(conversation_trie(frame(spark, rows, 5), bounds=bounds, queue=queue)) == brute(rebuilt(rows))


def test_long_copies_and_empty(spark):
    """One long conversation with a third of all turns, many copies of one, and members without turns."""
    long = [(20, t, "user", f"turn {t % 7}") for t in range(900)]
    copies = [(c, t, "user", f"hello {t}") for c in range(1000, 1300) for t in range(3)]
    rows = long + copies + [(41, 1, "user", "gone")]
    assert found(conversation_trie(frame(spark, rows), bounds=(10, 100))) == brute(rebuilt(rows))
    assert found(conversation_trie(frame(spark, []))) == []
    assert found(conversation_trie(frame(spark, [(None, 1, "a", "b")]))) == []
    repeated = [(7, 1, "user", "x"), (7, 1, "user", "x"), (7, None, None, None)]
    assert found(conversation_trie(frame(spark, repeated), heads=1)) == brute({7: [("", ""), ("user", "x"), ("user", "x")]})


def test_ties_do_not_depend_on_row_order(spark):
    rows = [(c, 1, "user", f"text {k}") for c in (1, 2) for k in range(6)]
    once = found(conversation_trie(frame(spark, rows), heads=1))
    assert once == found(conversation_trie(frame(spark, rows[::-1], 1), heads=1)) and len(once) == 7


def test_members_without_turns(spark):
    turns = spark.createDataFrame([(1, 1, "u", "a b"), (2, 1, "u", "a b")], "conv_id long, depth int, role string, text string")
    members = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "conv_id long")
    assert found(trie_of(turns, members)) == brute({1: [("u", "a b")], 2: [("u", "a b")], 3: []})


def test_sql(spark):
    rows = shared(8)
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    out = con.sql(OP11)
    assert out.columns == NAMES
    assert sorted(out.fetchall(), key=lambda r: (r[0], r[1])) == brute(rebuilt(rows))


def test_spilling_queue():
    rng = random.Random(3)
    for most in (1, 3, 1000):
        queue, held = SpillingQueue(most), []
        for _ in range(400):
            if held and rng.random() < 0.45:
                assert queue.head() == min(held)
                item = queue.pop()
                held.remove(item)
            else:
                held.append((rng.randint(0, 50), rng.randint(0, 5)))
                queue.push(held[-1])
        assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.head() is None
