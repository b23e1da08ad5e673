"""Cleaning functions on literal cases and against Python's own string methods."""

import random
import re

import pytest
from helpers import apply

from gistmill.functions import text

WHITESPACE = [chr(c) for c in range(0x110000) if chr(c).isspace()]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Rivers bend. Lakes wait.", "Rivers bend."),
        ("rain without an end", "rain without an end"),
        ("\t Owls hunt at night. Mice hide.", "Owls hunt at night."),
        ("Who knocks? Nobody answers.", "Who knocks?"),
        ("Stop! Look around.", "Stop!"),
        ("It grew approx. two meters. Nobody saw it.", "It grew approx. two meters."),
        ("Version 2.5 came. All was well.", "Version 2.5 came."),
        ("Une phrase. École ouverte. Then more.", "Une phrase. École ouverte."),
        ("Above the gap.\n\n\nBelow it.", "Above the gap."),
        ("", ""),
    ],
)
def test_first_sentence(spark, given, expected):
    assert apply(spark, text.first_sentence, [given]) == [expected]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Here's the TL;DR:\nBees dance to point the way.", "Bees dance to point the way."),
        ("Here's a short TL;DR:\nFrogs freeze and thaw.", "Frogs freeze and thaw."),
        ("What it says in short:\nGlass flows slowly, or not.", "Glass flows slowly, or not."),
        ('"Quoted all over."', "Quoted all over."),
        ("“Curly all over.”", "Curly all over."),
        ("‘mixed pair\"", "mixed pair"),
        ("*Leaning words.*", "Leaning words."),
        ("**Heavy words.**", "**Heavy words.**"),
        ("Nothing to clean up here.", "Nothing to clean up here."),
        ("Here's the TL;DR:\n\"Two layers gone.\"", "Two layers gone."),
        ("SURE! Here is my Brief tl dr — We show X.", "We show X."),
        ("Here’s the plain language TLDR:\n\n*Done.*", "Done."),
        ("One: \n\nTwo:\nthree", "Two:\nthree"),
        ("*", ""),
        ("**", "**"),
        ('"', '"'),
        ('""', ""),
        ("“*both*”", "both"),
        ("*“both”*", "“both”"),
        ("  spaced \x1c", "spaced"),
    ],
)
def test_clean_completion(spark, given, expected):
    assert apply(spark, text.clean_completion, [given]) == [expected]


def test_label_line_is_bounded(spark):
    long, limit = "x" * 120 + ":\nbody", "x" * 100 + ":\nbody"
    kept, dropped = apply(spark, text.clean_completion, [long, limit])
    assert kept == long and dropped == "body"


def test_every_whitespace_character(spark):
    assert len(WHITESPACE) == 29
    texts = [f"{c}a{c}{c}b{c}" for c in WHITESPACE]
    assert apply(spark, text.squeeze_whitespace, texts) == ["a b"] * 29
    assert apply(spark, text.word_count, texts) == [2] * 29
    assert apply(spark, text.strip, texts) == [t.strip() for t in texts]
    other = ["a​b", "a᠎b", "a﻿b", "a⁠b", "a‎b", "a‐b", "a、b"]
    assert apply(spark, text.word_count, other) == [1] * len(other)
    assert apply(spark, text.squeeze_whitespace, other) == other


def test_random_strings_against_python(spark):
    rng = random.Random(5)
    alphabet = WHITESPACE + list("abcXYZÉ.!?:\"*“”\n\n  ") + ["🙂", "​"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)]
    assert apply(spark, text.squeeze_whitespace, texts) == [" ".join(t.split()) for t in texts]
    assert apply(spark, text.word_count, texts) == [len(t.split()) for t in texts]
    expected = [re.compile(r"(?<=[.!?])\s+(?=[A-Z])").split(t.strip(), maxsplit=1)[0].strip() for t in texts]
    assert apply(spark, text.first_sentence, texts) == expected


def test_nulls_stay_null(spark):
    assert apply(spark, text.word_count, [None, "", "a b"]) == [None, 0, 2]
    assert apply(spark, text.first_sentence, [None]) == [None]


def test_ellipsize_counts_code_points(spark):
    assert apply(spark, lambda c: text.ellipsize(c, 3), ["abc", "abcd", "🙂🙂🙂", "🙂🙂🙂🙂"]) == [
        "abc", "abc…", "🙂🙂🙂", "🙂🙂🙂…",
    ]


def test_content_id(spark):
    import hashlib

    given = ["abc", "déjà vu"]
    assert apply(spark, text.content_id, given) == [hashlib.sha256(t.encode()).hexdigest()[:16] for t in given]
