"""Quality rules: how well a public vocabulary fits a text, with bands for each script."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import tables
from gistmill.llm.bpe import WordCache, spread
from gistmill.llm.words import SPACE, Words, slices, span_hashes, text_bytes, window_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True
#: Script by the first byte of a letter: 0 none, 1 Latin, 2 Greek or Cyrillic, 3 Hebrew or Arabic, 4 Indic or South-East Asian, 5 Chinese, Japanese or Korean, 6 others.
SCRIPTS = ("none", "latin", "greek_cyrillic", "hebrew_arabic", "indic", "cjk", "other")
_SCRIPT = np.zeros(256, np.int64)
_SCRIPT[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCD)]] = 1
_SCRIPT[0xCD:0xD5] = 2
_SCRIPT[0xD5:0xE0] = 3
_SCRIPT[0xE0:0xE2] = 4
_SCRIPT[0xE3:0xEE] = 5
_SCRIPT[[*range(0xEE, 0xF5)]] = 6


def _load_pieces(path: str):
    """The vocabulary's cache of words, and which of its ids are single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        body, cuts = data[spread(start, size)].tobytes(), np.concatenate([[0], np.cumsum(size)]).tolist()
        # the model reads a null character as the end of a text
        words = [body[a:b].decode("utf-8", "replace").replace("\0", "�") for a, b in zip(cuts[:-1], cuts[1:])]
        ids = model.encode(words, num_threads=1)
        counts = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum())), counts

    single = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return WordCache(encode), single


def _per_doc(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[cuts[1:]] - total[cuts[:-1]]


def _repeated(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by document and value, the group of each item in that order, and the groups' sizes."""
    order = np.lexsort((values, doc))
    new = np.ones(len(order), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(group) else np.zeros(0, np.int64)


def measures(texts: pa.Array, path: str) -> dict[str, np.ndarray]:
    """For each text its counts, its main script, and how the vocabulary at ``path`` fits it."""
    data, offsets = text_bytes(texts)
    words = Words(data, offsets)
    count = len(words.counts)
    doc = words.doc()
    letters = (data & 0xC0) != 0x80
    # lines: texts end with one, as with a line feed
    feeds = np.flatnonzero(data == 0x0A)
    of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    line_doc = np.concatenate([of_feed, np.arange(count)])
    line_end = np.concatenate([feeds, offsets[1:]])
    order = np.lexsort((line_end, line_doc))
    line_doc, line_end = line_doc[order], line_end[order]
    first = np.ones(len(line_doc), bool)
    first[1:] = line_doc[1:] != line_doc[:-1]
    line_start = np.where(first, offsets[line_doc], np.concatenate([[0], line_end[:-1] + 1])) if count else line_end
    worded = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_doc = line_doc[worded]
    order, group, _ = _repeated(line_doc, span_hashes(data, line_start[worded], line_end[worded]))
    kinds = np.bincount(line_doc[order][np.flatnonzero(np.diff(group, prepend=-1))], minlength=count)
    # words in windows that occur twice
    at = np.flatnonzero(words.left_in_doc() >= 5)
    order, group, sizes = _repeated(doc[at], window_hashes(words.hashes(), 5)[at])
    hit = at[order[sizes[group] > 1]] if len(at) else at
    edge = np.zeros(len(doc) + 6, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    cover = (np.cumsum(edge)[:len(doc)] > 0).astype(np.int64)
    # scripts
    script = _SCRIPT[data]
    # Glagolitic, Coptic, Tifinagh and the like begin as punctuation does
    script[:-1][(data[:-1] == 0xE2) & (data[1:] >= 0xB0) & (data[1:] < 0xB8)] = 6
    votes = np.stack([_per_doc(script == k, offsets) for k in range(1, len(SCRIPTS))], axis=1)
    main = np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1) + 1, 0)
    # tokens
    cache, single = tables.once(("pieces", path), lambda: _load_pieces(path))
    ids, cuts = cache.ids(words)
    tokens = np.diff(cuts)
    order, group, sizes = _repeated(np.repeat(np.arange(count), tokens), ids)
    owner = np.repeat(np.arange(count), tokens)[order][np.flatnonzero(np.diff(group, prepend=-1))] if len(ids) else np.zeros(0, np.int64)
    spent = np.bincount(owner, weights=sizes * np.log2(np.maximum(sizes, 1)), minlength=count)
    some = np.maximum(tokens, 1)
    word_chars = _per_doc(letters & ~SPACE[data], offsets)
    return {
        "n_words": words.counts, "word_chars": word_chars, "n_symbols": _per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_doc, minlength=count) - kinds, "n_repeat_words": _per_doc(cover, words.first),
        "script": main, "n_tokens": tokens, "chars_per_token": word_chars / some,
        "byte_share": _per_doc(single[ids], cuts) / some, "entropy": np.maximum(np.log2(some) - spent / some, 0),
    }


_KINDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "script": "string", "n_tokens": "long", "chars_per_token": "double", "byte_share": "double", "entropy": "double",
}


_MEASURES = ("entropy", "_entropy_above", "chars_per_token", "byte_share")


def _limits(passed: DataFrame, prior: float) -> DataFrame:
    """For each language, script and size medians and upper quartiles, drawn towards coarser bands the more, the fewer documents there are.

    ``mixed`` is the share that comes from the band that mixes languages.
    """
    # equal documents once, so that a text of many copies sets no band; rounded, so that exact percentiles count few distinct values
    rounded = [F.round(c, 2).alias(c) for c in _MEASURES]
    keys = ["_language", "_script", "_size"]
    distinct = tables.stored(passed.distinct().select(*keys, *rounded), narrow=True)
    levels = F.array(*[
        F.struct(F.lit(k).alias("_level"), *[(F.col(c) if c in kept else F.lit(None)).alias(f"_of{c}") for c in keys])
        for k, kept in enumerate(_LEVELS)
    ])
    of = [f"_of{c}" for c in keys]
    halves = F.array(F.lit(0.5), F.lit(0.75))
    bands = tables.stored(
        distinct.select(F.explode(levels).alias("_at"), *_MEASURES).select("_at.*", *_MEASURES).groupBy("_level", *of)
        .agg(F.count(F.lit(1)).alias("_count"), *[F.percentile(c, halves).alias(c) for c in _MEASURES]), narrow=True,
    )
    found = bands.filter("_level = 0").select(*[F.col(f"_of{c}").alias(c) for c in keys])
    for k, kept in enumerate(_LEVELS):
        value = F.struct(F.lit(float(k == len(_LEVELS) - 1)).alias("mixed"), *_MEASURES)
        level = bands.filter(F.col("_level") == k).select(
            *[F.col(f"_of{c}").alias(c) for c in kept], F.col("_count").alias(f"_count{k}"), value.alias(f"_limits{k}")
        )
        found = found.join(level, list(kept), "left")
    unknown = F.col("_language") == ""
    own = (F.col("_script") != "none") & (unknown | (10 * F.col("_count1") >= F.col("_count3")))
    usable = [own, own, ~unknown | (F.col("_script") == "none"), ~unknown | (F.col("_script") == "none"), F.col("_script") != "none"]
    # from the coarsest to the finest: of what there is so far, the share that ``prior`` documents would have
    for k in reversed(range(len(_LEVELS))):
        level, old = F.col(f"_limits{k}"), F.col("_limits")
        share = F.lit(prior) / (F.lit(prior) + F.col(f"_count{k}"))
        mix = lambda x, y: x + (y - x) * share  # noqa: E731, B023
        both = F.struct(mix(level["mixed"], old["mixed"]).alias("mixed"), *[F.zip_with(level[c], old[c], mix).alias(c) for c in _MEASURES])
        usable_here = usable[k] & level.isNotNull()
        if k == len(_LEVELS) - 1:
            found = found.withColumn("_limits", F.when(usable_here, level))
        else:
            found = found.withColumn("_limits", F.when(~usable_here | usable_here.isNull(), old).when(old.isNull(), level).otherwise(both))
    return found.select(*keys, "_limits")


#: What bands are set for, finest first.
_LEVELS = (("_language", "_script", "_size"), ("_language", "_script"), ("_language", "_size"), ("_language",), ("_script",))


def fertility_rules(
    docs: DataFrame, path: str, language_column: str | None = "lang", text_column: str = "text",
    least: float = -5.0, most_bytes: float = 0.25, prior: float = 20.0,
) -> DataFrame:
    """Columns of ``docs`` without the text, and counts, the vocabulary's fit, ``base_failed`` and ``kept``.

    The vocabulary at ``path`` (a sentencepiece model, on every executor) encodes each word of
    each whole text. Measures are characters per token, the share of tokens that stand for single bytes, and the entropy
    of the text's tokens in bits, as it is or less what is usual at its length, whichever is milder. Bands are set for each language and texts
    of alike length (powers of two of tokens), from the documents that pass the base rules; documents equal in all measures count once: a text
    is rejected whose entropy and characters per token lie together more than ``-least`` deviations
    below the medians, or whose byte share exceeds the median by ``most_bytes``. A deviation is the distance from the median to
    the upper quartile over 0.6745, of 0.08 bits and 0.03 characters at least: what lies below the median, junk maybe, doesn't widen it.

    A script that holds a tenth of its language's texts (any, where the language is null) has bands of its own; other scripts,
    and texts without letters, are held against the language. The coarser bands of a band are the script in the language at any length, the
    language at this length, the language, the script in all languages. Limits are drawn towards the next coarser band's as if ``prior`` documents
    of that had been seen besides the n of the band: by prior / (prior + n). So there is no number of documents at which another rule starts.
    The last mixes languages: by its share, deviations are 0.5 bits and 1 character at least, and twice ``most_bytes`` is allowed.
    Absolute limits hold in every band, so junk that is most of it goes too: a text is rejected without any letter, with
    symbols (#*$%&|<>) for more than 0.3 of its characters, with less than 0.3 of the bits that its tokens (1,024 at most) could have,
    or in Latin letters with fewer than one character a token.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in 5-word windows found
    twice. Null or empty text: all counts 0, ``base_failed``. A null language is one of its own.
    Input columns of the added names are replaced. No rows in, no rows out.
    """
    language = F.coalesce(F.col(language_column), F.lit("")) if language_column else F.lit("")
    schema = tables.with_fields(docs.schema, *_KINDS.items())
    schema.fields = [f for f in schema.fields if f.name != text_column]
    names = [f.name for f in schema.fields]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            found = measures(batch.column(text_column), path)
            found["script"] = np.array(SCRIPTS, object)[found["script"]]
            kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
            yield tables.replaced(batch, **{k: pa.array(found[k], kinds[kind]) for k, kind in _KINDS.items()}).select(names)

    measured = tables.stored(tables.in_arrow(docs, measure, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    log_tokens = F.log2(F.col("n_tokens") + 1)
    band = [language.alias("_language"), F.col("script").alias("_script"), F.floor(log_tokens).alias("_size")]
    # entropy usual at a length: its logarithm less 0.022 of its square, as words repeat; a rough curve, from whose median bands measure
    short = F.least(log_tokens, F.lit(16.0))
    above = (F.col("entropy") - short + 0.022 * short * short).alias("_entropy_above")
    limits = _limits(measured.filter(~failed).select("*", *band, above).select("_language", "_script", "_size", *_MEASURES, "n_words", "word_chars", "n_tokens"), prior)
    judged = measured.drop("base_failed").select("*", *band, above, failed.alias("base_failed")).join(limits, ["_language", "_script", "_size"], "left")

    def below(name: str, floor: float, mixed: float):
        q = F.col(f"_limits.{name}")
        return (F.col(name) - q[0]) / F.greatest((q[1] - q[0]) / 0.6745, floor + (mixed - floor) * F.col("_limits.mixed"))

    # a coarse band's texts may be shorter or longer: the milder view of the entropy counts
    together = F.greatest(below("entropy", 0.08, 0.5), below("_entropy_above", 0.08, 0.5)) + below("chars_per_token", 0.03, 1.0)
    too_many = F.col("byte_share") > F.col("_limits.byte_share")[0] + most_bytes * (1 + F.col("_limits.mixed"))
    absolute = (
        (F.col("script") == "none") | (F.col("n_symbols") > 0.3 * F.col("word_chars"))
        | (F.col("entropy") < 0.3 * F.least(F.log2(F.col("n_tokens")), F.lit(10.0))) | ((F.col("script") == "latin") & (F.col("chars_per_token") < 1.0))
    )
    rejected = absolute | F.coalesce(together < least, F.lit(False)) | F.coalesce(too_many, F.lit(False))
    kept = ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))
    return judged.select(*[c for c in measured.columns if c.lower() not in ("base_failed", "kept")], "base_failed", kept.alias("kept"))
