"""Texts -> token ids -> training examples -> padded batches."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmill import fixed_values as fx
from gistmill.functions import arrays, wordtable
from gistmill.functions.chat import ChatTemplate, render_example
from gistmill.functions.text import squeeze_whitespace
from gistmill.operators import lookup
from gistmill.operators.ordering import rank_rows
from gistmill.session import compute_once, materialize


def text_tokens(text: Column) -> Column:
    return F.array_remove(F.split(squeeze_whitespace(text), " "), "")


PAD_ID, UNKNOWN_ID, RESERVED = 0, 1, 2
_PLACE_BITS = 27
#: From rows and a Column of their numbers of ids to the same rows with more columns.
Place = Callable[[DataFrame, Column], DataFrame]
#: Words, and texts they are of, that are counted or asked for together.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """``(token, n, token_id)``: ids by count descending, then token, after the reserved ones for padding and unknown words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, _ in wordtable.blocks(batches, "_text", None, BLOCK_BYTES, BLOCK_ROWS):
            found = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["token", "n"])

    found = texts.select(F.col(text).alias("_text")).mapInArrow(count, "token string, n long")
    counts = found.groupBy("token").agg(F.sum("n").alias("n"))
    ranked = rank_rows(counts, [F.col("n").desc(), F.col("token")], out="rank")
    return ranked.select("token", "n", (F.col("rank") - 1 + RESERVED).alias("token_id"))


def encode(
    df: DataFrame,
    text: str,
    vocab: DataFrame,
    keys: Sequence[str],
    max_length: int | None = None,
    out: str = "input_ids",
    unknown_id: int = UNKNOWN_ID,
    broadcast_bytes: int = lookup.BROADCAST_BYTES,
    place: Place | None = None,
) -> DataFrame:
    """``keys`` and the token ids (64 bits) of ``text``, cut to ``max_length``; a row for each row of ``df``.

    Word ids do not depend on what follows, so the cut is made first. A vocabulary that was measured to be
    small is broadcast as a sorted array of hashes, and texts are encoded in their rows: nothing is shuffled or
    exploded. Beyond that, texts are packed into written blocks; each block asks for its distinct words once, by a
    shuffle, and meets their ids once.

    ``place`` numbers and batches the rows: it gets ``keys``, and columns that it must hand on as they are. In blocks
    these are only the text's place, and what it adds meets the ids there: neither texts nor ids travel for it.
    """
    if lookup.fits_broadcast(vocab, F.octet_length("token") + 24, broadcast_bytes):
        table = wordtable.broadcast_table(vocab, "token", "token_id")
        encoded = df.select(*keys, wordtable.number_udf(table, unknown_id, max_length)(F.col(text)).alias(out))
        return place(encoded, F.size(out)) if place else encoded
    return _encode_in_blocks(df.select(*keys, F.col(text).alias("_text")), vocab, list(keys), max_length, out, unknown_id, place)


def _encode_in_blocks(
    texts: DataFrame, vocab: DataFrame, keys: list[str], max_length: int | None, out: str, unknown_id: int, place: Place | None
) -> DataFrame:
    """A word is asked for once a block, however often texts have it: no word has more rows than there are blocks."""
    # keys are in a block's payload, or, to be placed, in rows of their own that come back to the block
    alone = place is not None
    held_keys = [] if alone else keys
    packed_schema = T.StructType.fromDDL("block long, at int, token string, payload binary")
    if alone:
        packed_schema = packed_schema.add("n", T.IntegerType()).add("row", T.StructType([texts.schema[k] for k in keys]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch, words, cuts in wordtable.blocks(batches, "_text", max_length, BLOCK_BYTES, BLOCK_ROWS):
            coded = words.dictionary_encode()
            codes = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), coded.indices.cast(pa.int32()))
            held = pa.RecordBatch.from_arrays([*[batch.column(k) for k in held_keys], codes], [*held_keys, "_codes"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(held)
            kinds = [{"payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())}, {"token": coded.dictionary.cast(pa.string())}]
            types = {"token": pa.string(), "payload": pa.binary()}
            if alone:
                row = pa.StructArray.from_arrays([batch.column(k) for k in keys], keys)
                kinds.append({"n": pa.array(np.diff(cuts), pa.int32()), "row": row})
                types |= {"n": pa.int32(), "row": row.type}
            for kind in kinds:
                size = len(next(iter(kind.values())))
                own = {"block": pa.array(np.full(size, block), pa.int64()), "at": pa.array(np.arange(size), pa.int32())}
                yield pa.RecordBatch.from_pydict(own | {c: kind.get(c, pa.nulls(size, t)) for c, t in types.items()})
            block += 1

    # place in the upper bits of a number, id in the lower
    bits = 63 - _PLACE_BITS

    def number(packed: pa.Table, found: pa.Table) -> pa.Table:
        own = pc.is_valid(packed.column("_payload"))
        with pa.ipc.open_stream(packed.filter(own).column("_payload")[0].as_buffer()) as reader:
            held = reader.read_next_batch()
        codes = held.column("_codes")
        flat, placed = np.asarray(codes.flatten()), found.column("placed").to_numpy()
        ids = np.full(int(flat.max(initial=-1)) + 1, unknown_id, np.int64)
        ids[placed >> bits] = placed & ((1 << bits) - 1)
        lists = pa.ListArray.from_arrays(codes.offsets, pa.array(ids[flat], pa.int64()))
        if alone:
            held = packed.filter(pc.invert(own)).sort_by("_slot")
        return pa.Table.from_arrays([*[held.column(k) for k in names], lists], [*names, out])

    blocks = materialize(texts.mapInArrow(pack, packed_schema))
    asked = blocks.filter(F.col("token").isNotNull()).select(F.col("block").alias("asker"), "at", "token")
    token_id = F.coalesce("token_id", F.lit(unknown_id)).cast("bigint")
    fits = (F.col("at") < 1 << _PLACE_BITS) & token_id.between(0, (1 << bits) - 1)
    placed = F.shiftleft(F.col("at").cast("bigint"), bits).bitwiseOR(token_id)
    placed = F.when(fits, placed).otherwise(F.raise_error(F.lit("too many words in a block or token id too large")).cast("bigint"))
    found = asked.join(vocab.select("token", "token_id"), "token").select("asker", placed.alias("placed"))
    packed = blocks.filter(F.col("payload").isNotNull()).select(F.col("block").alias("_home"), F.col("payload").alias("_payload"))
    fields = [texts.schema[k] for k in keys]
    if place is not None:
        rows = blocks.filter(F.col("n").isNotNull()).select(F.col("block").alias("_home"), F.col("at").alias("_slot"), F.col("n").alias("_n_ids"), "row.*")
        batched = place(rows, F.col("_n_ids")).drop("_n_ids")
        fields = [f for f in batched.schema if f.name not in ("_home", "_slot")]
        packed = packed.unionByName(batched, allowMissingColumns=True)
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.LongType()))])
    return packed.groupBy("_home").cogroup(found.groupBy("asker")).applyInArrow(number, schema)


def tokenizer_udf(factory: Callable[[], Callable[[str], Sequence[int]]]):
    """Column function ``text -> array<bigint>`` from a tokenizer of single texts made once per task."""
    return batch_tokenizer_udf(lambda: _one_by_one(factory()))


def _one_by_one(tokenizer: Callable[[str], Sequence[int]]) -> Callable[[list[str]], list[Sequence[int]]]:
    return lambda texts: [tokenizer(text) for text in texts]


def batch_tokenizer_udf(factory: Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]], rows: int = 1024):
    """Column function ``text -> array<bigint>`` from a tokenizer of lists of texts made once per task.

    The tokenizer gets up to ``rows`` texts a call, no nulls among them, and returns the ids of each, in order;
    another number of results is an error. A null text has null ids.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def tokenize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = factory()
        for texts in batches:
            ids = pd.Series([None] * len(texts), dtype=object)
            there = np.flatnonzero(texts.notna())
            for at in range(0, len(there), rows):
                places = there[at:at + rows]
                found = tokenizer(texts.iloc[places].tolist())
                if len(found) != len(places):
                    raise ValueError(f"tokenizer returned {len(found)} results for {len(places)} texts")
                for place, one in zip(places.tolist(), found):
                    ids.iat[place] = list(one)
            yield ids

    return tokenize


def padding_id(pad_id: int | None, end_id: int) -> int:
    """A tokenizer without a padding id pads with its end-of-text id."""
    return end_id if pad_id is None else pad_id


def with_completion_mask(encoded: DataFrame, prompt_length: str, ids: str = "input_ids") -> DataFrame:
    """Add labels with the prompt hidden, and the attention mask."""
    return encoded.withColumns({
        "attention_mask": arrays.attention_mask(F.col(ids)),
        "labels": arrays.completion_labels(F.col(ids), F.col(prompt_length)),
    })


def training_examples(
    records: DataFrame,
    vocab: DataFrame | None = None,
    tokenize: Callable[[Column], Column] | None = None,
    template: ChatTemplate = ChatTemplate(),
    max_length: int = fx.MAX_LENGTH,
    keys: Sequence[str] = ("split", "id"),
    masked: bool = True,
    place: Place | None = None,
) -> DataFrame:
    """Rendered, tokenized, cut and masked examples, from a vocabulary or a tokenizer.

    With a word vocabulary the prompt is only counted, not encoded. Masks follow from
    ids and prompt length; without ``masked`` they are left for :func:`pad_batches` to add. ``place`` is that of :func:`encode`.
    """
    prompt = render_example(F.col("abstract"), template=template)
    full = render_example(F.col("abstract"), F.col("summary"), template)
    if tokenize is not None:
        rendered = compute_once(records, _prompt=prompt, _full=full)
        tokenized = rendered.select(
            *keys, tokenize(F.col("_prompt")).alias("_prompt_ids"), tokenize(F.col("_full")).alias("_full_ids")
        )
        encoded = tokenized.select(
            *keys,
            F.size("_prompt_ids").alias("prompt_length"),
            arrays.truncate(F.col("_full_ids"), max_length).alias("input_ids"),
        )
        encoded = place(encoded, F.size("input_ids")) if place else encoded
    else:
        rendered = records.select(*keys, full.alias("_full"), wordtable.count_udf()(prompt).alias("prompt_length"))
        encoded = encode(rendered, "_full", vocab, [*keys, "prompt_length"], max_length, place=place)
    return with_completion_mask(encoded, "prompt_length") if masked else encoded


def with_longest(batched: DataFrame, length: Column, by: Sequence[str] = ("split",), out: str = "longest") -> DataFrame:
    """Add how long the longest example of each batch is."""
    return batched.withColumn(out, F.max(length).over(Window.partitionBy(*by, "batch_id")))


def pad_batches(
    batched: DataFrame, pad_id: int, by: Sequence[str] = ("split",), left: bool = False, longest: str | None = None
) -> DataFrame:
    """Pad every example to the longest of its batch: 64-bit ids, mask 0, labels ignored.

    ``longest`` names a column that already says how long that is; without it batches are brought together.

    The attention mask is added if it is missing, and labels if there is a prompt length,
    after examples have met their batch: only ids travel.
    """
    pad = arrays.pad_left if left else arrays.pad_right
    fills = {"input_ids": pad_id, "attention_mask": 0, "labels": fx.IGNORED_LABEL}
    padded = batched.withColumn("_longest", F.col(longest).cast("int")) if longest else with_longest(batched, F.size("input_ids"), by, "_longest")
    if "labels" not in padded.columns and "prompt_length" in padded.columns:
        padded = with_completion_mask(padded, "prompt_length")
    elif "attention_mask" not in padded.columns:
        padded = padded.withColumn("attention_mask", arrays.attention_mask(F.col("input_ids")))
    return padded.withColumns({
        name: pad(F.col(name), F.col("_longest"), fill) for name, fill in fills.items() if name in padded.columns
    }).drop("_longest")
