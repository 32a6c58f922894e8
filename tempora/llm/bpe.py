"""BPE encoding and decoding by tree concatenation.

A text of up to ``leaf_chars`` code points is encoded at once.  A longer one is halved until its pieces are short
enough, the pieces are dealt over the cluster and encoded as if each stood alone, and then neighbours are joined,
two by two, up the tree.  Only the neighbourhood of a join can be wrong.  A window around the join is encoded
again, from a word start of the left half to a little beyond a word start of the right half; the window grows until
it agrees with both: it begins at a word start that no later text can move, and it shares with the right half a
word start, from which on both must go on alike.  Then left ids, window ids and right ids are put together.  A word that goes on
over the join, however long, is put together in the same way from tokens: only a window of its tokens is encoded again
(:func:`joined_ids`).  What repeats with a short period has no agreement but at its end, and its right part is encoded again.

The vocabulary is a file of ranks with its word pattern; one special string has an id of its own and is recognised
in texts.  ``SAFE`` code points are more than the pattern's look-ahead or the special string can reach.

Defined cases: a null text counts as empty (no ids); rows that repeat a doc_id are encoded each for itself; a null
doc_id is passed through; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_small_batches

LEAF_CHARS = 32_768
SAFE = 64


@dataclass(frozen=True)
class Vocabulary:
    """A file of base64 tokens and ranks, the word pattern and the special strings with their ids."""

    path: str
    pattern: str
    special: tuple[tuple[str, int], ...]

    @classmethod
    def byte_bpe_50k(cls) -> Vocabulary:
        import public_tokenizers

        return cls(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))


@functools.lru_cache(maxsize=2)
def _encoding(vocabulary: Vocabulary) -> tiktoken.Encoding:
    with open(vocabulary.path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("tempora", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.special))


@functools.lru_cache(maxsize=2)
def _token_bytes(vocabulary: Vocabulary) -> np.ndarray:
    """How many bytes each id stands for."""
    coder = _encoding(vocabulary)
    lengths = np.zeros(coder.n_vocab, np.int64)
    for token in coder.token_byte_values():
        lengths[coder.encode_single_token(token)] = len(token)
    for special, number in vocabulary.special:
        lengths[number] = len(special.encode())
    return lengths


def _id_kind(vocabulary: Vocabulary) -> type:
    return np.uint16 if _encoding(vocabulary).n_vocab <= 1 << 16 else np.int32


@functools.lru_cache(maxsize=2)
def _splitter(vocabulary: Vocabulary) -> regex.Pattern:
    return regex.compile("|".join([*(regex.escape(s) for s, _ in vocabulary.special)]))


@functools.lru_cache(maxsize=2)
def _words(vocabulary: Vocabulary) -> regex.Pattern:
    return regex.compile(vocabulary.pattern)


def encode(vocabulary: Vocabulary, text: str) -> np.ndarray:
    return np.asarray(_encoding(vocabulary).encode(text, allowed_special="all"), dtype=np.int32)


def word_starts(vocabulary: Vocabulary, text: str) -> list[int]:
    """Where the words and special strings of ``text`` start, and its end."""
    starts, at = [], 0
    words = _words(vocabulary)
    for special in [*_splitter(vocabulary).finditer(text), None]:
        end = special.start() if special else len(text)
        starts += (at + m.start() for m in words.finditer(text[at:end]))
        if special:
            starts.append(end)
            at = special.end()
    return [*starts, len(text)]


@dataclass
class Piece:
    """A text, its ids, and how many ids stand before each word start."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, vocabulary: Vocabulary, text: str) -> Piece:
        starts = word_starts(vocabulary, text)
        special = dict(vocabulary.special)
        coder = _encoding(vocabulary)
        words = [text[a:b] for a, b in zip(starts, starts[1:])]
        ids = [[special[w]] if w in special else coder.encode_ordinary(w) for w in words]
        before = np.cumsum([0, *map(len, ids)])
        return cls(text, np.asarray([i for word in ids for i in word], dtype=np.int32), np.asarray(starts, dtype=np.int64), before)

    def packed(self, vocabulary: Vocabulary) -> tuple[bytes, bytes]:
        """The ids, and a bit for each that is set where a word starts: all that a piece is made of."""
        bits = np.zeros(len(self.ids), bool)
        bits[self.before[:-1]] = True
        return self.ids.astype(_id_kind(vocabulary)).tobytes(), np.packbits(bits).tobytes()

    @classmethod
    def unpacked(cls, vocabulary: Vocabulary, ids: bytes, bits: bytes) -> Piece:
        numbers = np.frombuffer(ids, _id_kind(vocabulary)).astype(np.int32)
        before = np.append(np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(numbers))), len(numbers))
        raw = _encoding(vocabulary).decode_bytes(numbers.tolist())
        at_byte = np.concatenate([[0], np.cumsum(_token_bytes(vocabulary)[numbers])])
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        return cls(raw.decode(), numbers, chars[at_byte[before]], before)


def joined_ids(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """The ids of one word from those of its two parts, and how many ids the window had.

    A run of tokens is what BPE makes of its bytes exactly if that holds for each two neighbours in it.  So a window of tokens around
    the join is encoded again, and grows until it begins with the token it began with before and ends likewise: then all
    neighbours are ones of the left part, of the window or of the right part.
    """
    coder, reach = _encoding(vocabulary), 16
    while True:
        i, j = max(0, len(left) - reach), min(len(right), reach)
        window = np.asarray(coder._encode_single_piece(coder.decode_bytes([*left[i:].tolist(), *right[:j].tolist()])), dtype=np.int32)
        if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
            return np.concatenate([left[:i], window, right[j:]]), len(left) - i + j
        reach *= 2


def joined(vocabulary: Vocabulary, left: Piece, right: Piece) -> Piece:
    """The piece of both texts, from both pieces and a window around their join."""
    if not left.text or not right.text:
        return left if left.text else right
    text, join, reach = left.text + right.text, len(left.text), 4 * SAFE
    # From here on only the left text before the join decides what a word is.
    i = max(0, int(np.searchsorted(left.starts, max(0, join - reach), "right")) - 1)
    begin = int(left.starts[i]) if join - left.starts[i] >= SAFE else 0
    i = i if begin else 0
    while True:
        # A word start of both the window and the right text, past the join and well before the window's end.
        end = min(len(text), join + reach)
        starts = np.asarray(word_starts(vocabulary, text[begin:end]), dtype=np.int64) + begin
        both = np.intersect1d(starts - join, right.starts)
        both = both[(both >= SAFE) & (both <= reach - SAFE)] if end < len(text) else np.asarray([len(right.text)])
        if len(both):
            break
        reach *= 2
    stop = join + int(both[0])
    k = int(np.searchsorted(right.starts, both[0]))
    starts = starts[:np.searchsorted(starts, stop)]
    ids = [_word_ids(vocabulary, left, right, text, int(a), int(b)) for a, b in zip(starts, [*starts[1:], stop])]
    lengths = np.cumsum([0, *map(len, ids)])
    before = left.before[i]
    return Piece(text, np.concatenate([left.ids[:before], *ids, right.ids[right.before[k]:]]),
                 np.concatenate([left.starts[:i], starts, right.starts[k:] + join]),
                 np.concatenate([left.before[:i], lengths[:-1] + before, right.before[k:] - right.before[k] + before + lengths[-1]]))


def _word_ids(vocabulary: Vocabulary, left: Piece, right: Piece, text: str, a: int, b: int) -> np.ndarray:
    """The ids of the word from ``a`` to ``b``: those of a half that has it as a word, those of its parts, joined, if it goes on from the last word of the
    left half to the first of the right one, else encoded."""
    join = len(left.text)
    if b <= join:
        w = int(np.searchsorted(left.starts, a))
        if left.starts[w] == a and left.starts[w + 1] == b:
            return left.ids[left.before[w]:left.before[w + 1]]
    elif a >= join:
        w = int(np.searchsorted(right.starts, a - join))
        if right.starts[w] == a - join and right.starts[w + 1] == b - join:
            return right.ids[right.before[w]:right.before[w + 1]]
    elif left.starts[-2] == a and right.starts[1] == b - join:
        parts = left.ids[left.before[-2]:], right.ids[:right.before[1]]
        if not {number for _, number in vocabulary.special} & {int(parts[0][0]), int(parts[1][0])}:
            return joined_ids(vocabulary, *parts)[0]
    return encode(vocabulary, text[a:b])


def concatenated(vocabulary: Vocabulary, pieces: list[Piece]) -> Piece:
    """Join neighbours, level by level, until one piece is left."""
    while len(pieces) > 1:
        pieces = [joined(vocabulary, *pieces[i:i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    return _encoding(vocabulary).decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


def leaves(text: str, leaf_chars: int) -> list[str]:
    """The text halved until no piece is longer than ``leaf_chars``."""
    if len(text) <= leaf_chars:
        return [text]
    half = (len(text) + 1) // 2
    return [*leaves(text[:half], leaf_chars), *leaves(text[half:], leaf_chars)]


def _short(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoding(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 1000):
                ids = [coder.encode(t, allowed_special="all") for t in texts[at:at + 1000]]
                back = [coder.decode_bytes(x).decode("utf-8", errors="replace") for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 1000), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    return run


def _cut(leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                parts = leaves(text, leaf_chars)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array([doc_id] * len(parts), batch.schema.field("doc_id").type),
                                                  pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], names=["row", "doc_id", "leaf", "text"])

    return run


def _leaf(vocabulary: Vocabulary):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            packed = [Piece.of(vocabulary, t).packed(vocabulary) for t in frame["text"]]
            yield frame.drop(columns="text").assign(ids=[ids for ids, _ in packed], word_bits=[bits for _, bits in packed])

    return run


def _tree(vocabulary: Vocabulary):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("leaf")
        whole = concatenated(vocabulary, [Piece.unpacked(vocabulary, ids, bits) for ids, bits in zip(frame["ids"], frame["word_bits"])])
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1].to_numpy(), "ids": [whole.ids], "decoded": [decode(vocabulary, whole.ids)]})

    return run


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int) and decoded, the text that the ids stand for."""
    vocabulary = vocabulary or Vocabulary.byte_bpe_50k()
    kind = docs.schema["doc_id"].dataType
    base = in_small_batches(docs).select("doc_id", "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > leaf_chars
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    short = base.where(~long).mapInArrow(_short(vocabulary), out)
    cut = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("leaf", T.LongType()), T.StructField("text", T.StringType())])
    parts = T.StructType([*(f for f in cut if f.name != "text"), *(T.StructField(c, T.BinaryType()) for c in ("ids", "word_bits"))])
    pieces = (base.where(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_cut(leaf_chars), cut)
              .repartition("row", "leaf").mapInPandas(_leaf(vocabulary), parts))
    return short.unionAll(pieces.groupBy("row").applyInPandas(_tree(vocabulary), out))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what :func:`encoded` returns."""
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))
