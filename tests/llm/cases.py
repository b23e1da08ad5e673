"""Documents for the tests: copies, near copies, shared passages and lines, and awkward rows."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of documents, and names that operators use themselves.
CLASHING = ["n_words", "N_LINES", "part", "block", "payload", "id", "row", "version", "lines", "key", "rep", "score", "kept", "ids", "length"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in CLASHING]
)


def vocabulary(rng: random.Random, size: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(1, 8))) for _ in range(size)]


def corpus(seed: int = 1, size: int = 120) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = vocabulary(rng, 400)
    passage = [" ".join(rng.choices(words, k=20)) for _ in range(3)]
    line = " ".join(rng.choices(words, k=14))
    docs: list[tuple[int, str | None]] = []
    for i in range(size):
        kind = rng.random()
        text = " ".join(rng.choices(words, k=rng.randint(1, 120)))
        if kind < 0.2 and docs:
            text = rng.choice(docs)[1] or ""
        elif kind < 0.45 and docs:
            old = (rng.choice(docs)[1] or "").split(" ")
            for _ in range(1 + len(old) // 60):
                old[rng.randrange(len(old))] = rng.choice(words)
            text = " ".join(old)
        elif kind < 0.6:
            text = text + "\n" + rng.choice(passage) + "\t" + rng.choice(words)
        elif kind < 0.8:
            text = text + "\n  " + (line.upper() if rng.random() < 0.5 else line) + " \n" + rng.choice(words)
        docs.append((i, text))
    return docs


def awkward() -> list[tuple[int | None, str | None]]:
    long = " ".join(vocabulary(random.Random(9), 3000))
    return [
        (1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "\n\n"), (1005, long), (1006, long + " end"), (1007, long),
        (None, long), (None, None), (1008, "naïve Straße 你好 \U0001f600 " * 9), (1008, "naïve Straße 你好 \U0001f600 " * 9),
        (-5, "a b c d e f g h i j k l m n o p"), (1009, "a b c d e f g h i j k l m n o p"), (1009, "other text of the same id"), (1010, "x" * 5000),
    ]


def frame(spark, rows, partitions: int = 3):
    full = [(i, text, "en" if i is None or i % 3 else None) + tuple(f"{name} {i}" for name in CLASHING) for i, text in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def order(doc_id: int | None) -> int:
    return (1 << 63) - 1 if doc_id is None else doc_id


def kept_columns(before, after, changed: set[str]) -> None:
    """Input columns that the operator doesn't name come back with their values."""
    names = [c for c in before.columns if c.lower() not in changed]
    assert set(names) <= set(after.columns)
    assert len({c.lower() for c in after.columns}) == len(after.columns)
    key = lambda r: str(r)
    assert sorted(map(key, before.select(names).collect())) == sorted(map(key, after.select(names).collect()))
