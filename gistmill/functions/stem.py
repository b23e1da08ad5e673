"""Porter stemming inside tasks: a small per-word helper behind an Arrow UDF.

Texts stay whole rows, so stemming needs no shuffle and no join on (very
unevenly spread) words; each task remembers the words it has seen last.
"""

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill import fixed_values as fx
from gistmill.functions.wordtable import in_pieces, split_words

#: Words whose stems a task holds.
REMEMBERED = 1 << 16


def _shape(word: str) -> str:
    """One ``c`` or ``v`` per letter; a y after a consonant counts as a vowel."""
    shape = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_syllable(word: str) -> bool:
    shape = _shape(word)
    return shape == "vc" or (shape.endswith("cvc") and word[-1] not in "wxy")


def _swap(word: str, rules, accept) -> str:
    """Apply the first rule whose suffix fits, if ``accept(stem, suffix)`` allows it."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if accept(stem, suffix) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past_or_gerund(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-1:] == stem[-2:-1] and _shape(stem).endswith("c"):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_syllable(stem) else stem


def _double_suffix(word: str) -> str:
    while word.endswith("alli") and _measure(word[:-4]):
        word = word[:-2]
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) else word
    return _swap(word, fx.STEM_STEP2, lambda stem, _: _measure(stem))


def _residue(word: str) -> str:
    def accept(stem: str, suffix: str) -> bool:
        return _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t"))

    return _swap(word, ((suffix, "") for suffix in fx.STEM_STEP4), accept)


def _final_letters(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_syllable(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def porter_stem(word: str) -> str:
    """Stem of a lower-case word."""
    if word in fx.STEM_EXCEPTIONS:
        return fx.STEM_EXCEPTIONS[word]
    if len(word) <= 2:
        return word
    word = _past_or_gerund(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1]).endswith("c"):
        word = word[:-1] + "i"
    word = _double_suffix(word)
    word = _swap(word, fx.STEM_STEP3, lambda stem, _: _measure(stem))
    return _final_letters(_residue(word))


def stem_texts(texts: pa.Array, stem: Callable[[str], str]) -> pa.Array:
    """Texts of space-separated words with every long enough word stemmed; distinct words are stemmed once."""
    words, cuts = split_words(texts, None)
    coded = words.dictionary_encode()
    stems = [stem(word) if len(word) >= fx.STEM_MIN_CHARS else word for word in coded.dictionary.to_pylist()]
    stemmed = pa.array(stems, pa.string()).take(coded.indices)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), stemmed), " ")


def remembering_stemmer() -> Callable[[str], str]:
    return lru_cache(maxsize=REMEMBERED)(porter_stem)


@F.arrow_udf(T.StringType())
def stem_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem every long enough word of space-separated texts."""
    stem = remembering_stemmer()
    for texts in batches:
        yield in_pieces([texts], lambda part: stem_texts(part, stem), pa.string())
