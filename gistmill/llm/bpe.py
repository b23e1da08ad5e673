"""Byte-pair encoding and decoding of whole texts with a public vocabulary, by batched numpy merge rounds."""

import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gistmill.llm import tables
from gistmill.llm.words import Words, slices, text_bytes

#: Fixed: what the vocabulary file's pre-tokenizer keeps, with Unicode's white space spelt out.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+"
)
#: Beyond these come scripts whose newest letters this Python may not know yet.
_OFTEN = regex.compile(r"[\x00-\u0557\u1e00-\u1fff\u2010-\u2064\u20a0-\u20bf\u3001-\ua6ff\uac00-\ud7a3\uf900-\ufaff\uff01-\uffee]*+")
_NONE = np.int32(2**31 - 1)
_ALPHABET = np.zeros(256, bool)
_ALPHABET[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of groups that begin and are as long as given, one group after another."""
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - at, size)


class WordCache:
    """Ids of words by their 64-bit hash, encoded when first met, and started anew when it holds too many.

    Two words of one hash would share ids: about once in 100 TB of text.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = 1 << 19):
        self.encode, self.most = encode, most
        self._empty()

    def _empty(self) -> None:
        self.keys, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lookup(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct word begin and size in ``flat``, and each word's distinct number."""
        keys, first, of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._empty()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            new = ~known
            flat, size = self.encode(words.data, words.start[first[new]], words.end[first[new]])
            begin = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, flat])
            order = np.argsort(np.concatenate([self.keys, keys[new]]), kind="stable")
            self.keys = np.concatenate([self.keys, keys[new]])[order]
            self.begin = np.concatenate([self.begin, begin])[order]
            self.size = np.concatenate([self.size, size])[order]
            place = np.searchsorted(self.keys, keys)
        return self.begin[place], self.size[place], of

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each text's begin and the last's end."""
        begin, size, of = self.lookup(words)
        of = of.ravel()
        flat = self.flat[spread(begin[of], size[of])]
        ends = np.concatenate([[0], np.cumsum(size[of])])
        return flat, ends[words.first]


class BytePairs:
    """A byte-level vocabulary with ends of words: lower case, composed characters, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.path = path
        letters = _byte_letters()
        self.letters = {x: b for b, x in enumerate(letters)}
        self.middle = np.array([vocabulary[x] for x in letters], np.int32)
        self.last = np.array([vocabulary[x + suffix] for x in letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs by binary search over the sorted pair keys."""
        wanted = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.ranks[place], _NONE)

    def merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as bytes one after another: in each round every piece merges its lowest-ranked pair.

        Returns ids and their number for each piece. A pair that overlaps itself is merged from the left.
        """
        symbols = self.middle[data]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[data[ends - 1]]
        piece = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(symbols), _NONE)
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        done = []
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            count = np.diff(np.append(begin, len(symbols)))
            least = np.minimum.reduceat(rank, begin)
            over = np.repeat(least == _NONE, count)
            if over.any():
                done.append((piece[over], symbols[over]))
                symbols, piece, rank = symbols[~over], piece[~over], rank[~over]
                count, least = count[least != _NONE], least[least != _NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(least, count))
            follows = np.concatenate([[False], (at[1:] == at[:-1] + 1)])
            if follows.any():
                run = np.flatnonzero(~follows)
                at = at[(np.arange(len(at)) - run[np.cumsum(~follows) - 1]) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            symbols, piece, rank = symbols[keep], piece[keep], rank[keep]
            changed = np.concatenate([at[at > 0] - 1, at])
            same = np.zeros(len(changed), bool)
            within = changed + 1 < len(symbols)
            same[within] = piece[changed[within]] == piece[changed[within] + 1]
            rank[changed[~same]] = _NONE
            changed = changed[same]
            rank[changed] = self.rank(symbols[changed], symbols[changed + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        piece, symbols = (np.concatenate(x) for x in zip(*done))
        return symbols[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(size))

    def _pieces(self, word: str) -> list[bytes | int]:
        """Pieces of a word without ASCII white space: bytes to merge, or the id of a special token."""
        out: list[bytes | int] = []
        for part in self.split_special.split(word) if self.split_special and "<|" in word else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif not _OFTEN.fullmatch(part) and any(unicodedata.category(x) == "Cn" for x in part):
                out.extend(self._newer_pieces(part))
            else:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.extend(x.encode() for x in PIECES.findall(part))
        return out

    def _newer_pieces(self, part: str) -> list[bytes]:
        """Pieces by the tokenizers library, for characters newer than Python's tables."""
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(self.letters[x] for x in piece) for piece, _ in found]

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their bytes, and their number for each word."""
        size = end - start
        body = data[spread(start, size)]
        cuts = np.concatenate([[0], np.cumsum(size)])
        plain = np.add.reduceat(_ALPHABET[body].astype(np.int64), cuts[:-1]) == size
        owner, parts, special = [np.flatnonzero(plain)], [_FOLD[body[np.repeat(plain, size)]]], []
        sizes = [size[plain]]
        other, found = [], []
        raw = body.tobytes()
        for k in np.flatnonzero(~plain).tolist():
            for piece in self._pieces(raw[cuts[k]:cuts[k + 1]].decode("utf-8", "replace")):
                if isinstance(piece, int):
                    special.append((len(owner[0]) + len(found), piece))
                    piece = b"a"
                other.append(k)
                found.append(piece)
        owner = np.concatenate([owner[0], np.array(other, np.int64)])
        sizes = np.concatenate([sizes[0], np.array([len(x) for x in found], np.int64)])
        flat, count = self.merge(np.concatenate([parts[0], np.frombuffer(b"".join(found), np.uint8)]), sizes)
        begin = np.cumsum(count) - count
        for place, number in special:
            flat[begin[place]] = number
        order = np.argsort(owner, kind="stable")
        flat = flat[spread(begin[order], count[order])]
        return flat, np.bincount(owner, weights=count, minlength=len(size)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, as the vocabulary file, which names no decoder, has it."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


def _byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def encoder(path: str) -> tuple[BytePairs, WordCache]:
    """The vocabulary and its cache of words, once for each worker process."""

    def make() -> tuple[BytePairs, WordCache]:
        pairs = BytePairs(path)
        return pairs, WordCache(pairs.encode_words)

    return tables.once(("byte pairs", path), make)


def encoded(batch: pa.RecordBatch, text_column: str, path: str) -> tuple[BytePairs, np.ndarray, np.ndarray]:
    pairs, cache = encoder(path)
    ids, cuts = cache.ids(Words(*text_bytes(batch.column(text_column))))
    return pairs, ids, cuts


def encode_texts(docs: DataFrame, path: str, text_column: str = "text", decoded: bool = False) -> DataFrame:
    """Columns of ``docs`` and ``ids`` (array of int) and, if asked for, ``decoded`` (string); such columns are replaced.

    Ids are those of the vocabulary file at ``path``, which every executor must have: strings of special tokens
    become their ids, other text is composed, lower-cased and cut into pieces; no special
    tokens are added. Distinct words are encoded once for each worker and batch, in numpy: all
    symbols of all words lie in one array, and each round merges the lowest-ranked pair of every
    word. Nothing is shuffled.

    Null or empty text, or white space alone: no ids, empty decoded text. No rows in, no rows out.
    """
    added = [("ids", "array<int>")] + [("decoded", "string")] * decoded
    schema = tables.with_fields(docs.schema, *added)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            pairs, ids, cuts = encoded(batch, text_column, path)
            columns = {"ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))}
            if decoded:
                texts = [pairs.decode(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                columns["decoded"] = pa.array(texts, pa.string())
            yield tables.replaced(batch, **columns)

    return tables.in_arrow(docs, encode, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))


def encode_digests(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """Columns of ``docs`` and ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of what ``encode_texts`` gives.

    For checks of whole corpora: ids and decoded texts stay in their task.
    """
    import hashlib

    added = (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))
    schema = tables.with_fields(docs.schema, *added)
    schema.fields = [f for f in schema.fields if f.name != text_column]
    names = [f.name for f in schema.fields]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 4 << 20):
            pairs, ids, cuts = encoded(batch, text_column, path)
            parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield tables.replaced(
                batch,
                n_tokens=pa.array(np.diff(cuts), pa.int64()),
                ids_sha256=pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in parts], pa.string()),
                decoded_sha256=pa.array([hashlib.sha256(pairs.decode(x).encode()).hexdigest() for x in parts], pa.string()),
            ).select(names)

    return tables.in_arrow(docs, digest, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))
