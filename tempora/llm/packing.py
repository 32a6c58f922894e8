"""Hierarchical packing of tokenized documents into sequences of several context sizes.

Context sizes are tiers of powers of two up to ``most``.  A document is its ids and an end id; whole windows of the longest tier are cut off
its front, and the rest is routed to the smallest tier that holds it.  From the longest tier down, each of its items opens a window; the gap
is filled with the largest items of shorter tiers that fit, and what is left of it with a piece cut off a
longer one, so a window is full.  Windows that no shorter item is left for are run together and cut into full windows again; the last of
them is cut by its binary digits into sequences of a power of two (those may be shorter than the shortest tier: at most one of each size a shard).
A sequence of a power of two isn't padded, so nothing is.

Sequences are dealt to step groups of ``STEP_TOKENS`` tokens, the longest first, each to the group that has the fewest, so groups hold nearly the
same number of tokens and of each tier.

The work is local to a task: rows are tokenized and packed in shards of some ``SHARD_TOKENS`` ids, in the order in which they are read, so there is no shuffle,
a source or a group of copies of any size is spread like all other rows, and a task that is run again gives the same sequences.  Numbers of sequences
and groups begin with the task's number.

Ids are those of the tokenizers library.  Nothing of the vocabulary's pattern reaches across ASCII white space (and its special strings have none), so a
text is cut there, and ids of the first ``WORDS_KEPT`` words that a worker meets are kept.  A new word of Latin characters without special strings is
lower-cased and divided by the vocabulary's pattern, and the library's model encodes what is new of it; any other word is encoded by the whole library.

Defined cases: a null text counts as empty, and a document without ids is its end id alone; a text longer than a shard is a shard by itself
(its ids, of two or four bytes each, are held; its text is encoded in pieces); rows that share a doc_id are packed each for itself; a null doc_id is passed
through; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 2048
TIERS = 4
SHARD_TOKENS = 1 << 21
STEP_TOKENS = 16 * MOST
WORDS_KEPT = 400_000
_CHUNK = 1 << 17
#: Characters that the vocabulary's normalisation (canonical composition) leaves alone: up to the end of the Latin blocks.
_OTHER = "[^\x00-\u024F]"
#: Longer words are not kept.
_LONG_WORD = 64


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file of the tokenizers library and the id that ends a document.

    ``parts`` is the pattern by which the file's pre-tokenizer divides words of Latin text, once they are in lower case, for a byte-level
    vocabulary; without it the whole library encodes all words.
    """

    path: str
    end_id: int = 1
    parts: str | None = None

    @classmethod
    def word_bpe_49k(cls) -> Vocabulary:
        import public_tokenizers

        latin = [chr(c) for c in range(0x250)]
        letters = "".join(c for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        return cls(public_tokenizers.path("word_bpe_49k.json"),
                   parts=f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\x09-\\x0D\\x20\x85\xA0{letters}{numbers}]+")


@functools.lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: those without a visible Latin-1 character as characters from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}


class Encoder:
    """Ids of whole texts."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = _library(vocabulary.path), array("I", [vocabulary.end_id]).tobytes()
        self.model = Tokenizer(self.tokenizer.model)
        self.parts = vocabulary.parts and re.compile(vocabulary.parts)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([_OTHER, *special]))
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of ``text`` and the end id."""
        data, at, found = (text or "").encode(), 0, []
        while at < len(data):
            end = len(data)
            if at + _CHUNK < end:
                end = min((p for p in (data.find(blank, at + _CHUNK) for blank in (b" ", b"\n")) if p >= 0), default=end)
            words = data[at:end].split()
            ids = list(map(self.words.get, words))
            if None in ids:
                new = self._encoded({w for w, i in zip(words, ids) if i is None})
                ids = [new[w] if i is None else i for w, i in zip(words, ids)]
                if len(self.words) < WORDS_KEPT:
                    self.words.update((w, i) for w, i in new.items() if len(w) <= _LONG_WORD)
            found += ids
            at = end
        return np.frombuffer(b"".join([*found, self.end]), "<u4")

    def _encoded(self, words: set[bytes]) -> dict[bytes, bytes]:
        parts, others = {}, []
        for word in words:
            if self.parts and word.isalpha():
                parts[word] = (word.lower().decode(),)
            elif not self.parts or self.other.search(text := word.decode()):
                others.append(word)
            else:
                parts[word] = self.parts.findall(text.lower())
        new = list({p for of in parts.values() for p in of if p not in self.known})
        written = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters) for p in new]
        ids = {p: array("I", e.ids).tobytes() for p, e in zip(new, self.model.encode_batch_fast(written, add_special_tokens=False) if new else [])}
        if len(self.known) < WORDS_KEPT:
            self.known.update((p, i) for p, i in ids.items() if len(p) <= _LONG_WORD)
        known = self.known
        out = {w: b"".join([ids.get(p) or known[p] for p in of]) for w, of in parts.items()}
        for word, encoding in zip(others, self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False) if others else []):
            out[word] = array("I", encoding.ids).tobytes()
        return out


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One a worker, so its words serve all tasks that the worker runs."""
    return Encoder(vocabulary)


#: A piece: (document's number in its shard, ids before it, length).
Piece = tuple[int, int, int]


def _powers(total: int, most: int) -> list[int]:
    """``total`` as full windows and then its binary digits, falling."""
    return [most] * (total // most) + [1 << i for i in range(most.bit_length() - 2, -1, -1) if total % most >> i & 1]


def _cut(pieces: list[Piece], lengths: list[int]) -> list[list[Piece]]:
    """A run of pieces cut into windows of the given lengths, which add up to it."""
    windows, rest = [], pieces[::-1]
    for length in lengths:
        window: list[Piece] = []
        while length:
            doc, start, n = rest.pop()
            if n > length:
                rest.append((doc, start + length, n - length))
                n = length
            window.append((doc, start, n))
            length -= n
        windows.append(window)
    return windows


class _Items:
    """Items of tiers that are yet to be packed, by length."""

    def __init__(self, items: list[Piece]):
        self.lengths = sorted({n for _, _, n in items})
        self.of: dict[int, list[Piece]] = {}
        for item in items:
            self.of.setdefault(item[2], []).append(item)

    def add(self, item: Piece) -> None:
        if item[2] not in self.of:
            self.of[item[2]] = []
            insort(self.lengths, item[2])
        self.of[item[2]].append(item)

    def take(self, at: int) -> Piece:
        """An item of the length at this place of ``lengths``."""
        length = self.lengths[at]
        item = self.of[length].pop()
        if not self.of[length]:
            del self.of[length], self.lengths[at]
        return item


def packed_windows(sizes: list[int], most: int = MOST, tiers: int = TIERS) -> list[list[Piece]]:
    """Windows of pieces for documents of the given numbers of ids; each has a power of two of them, at most ``most``."""
    windows, items, left_open = [], [], []
    for doc, size in enumerate(sizes):
        whole = size - size % most
        windows += ([(doc, start, most)] for start in range(0, whole, most))
        if size > whole:
            items.append((doc, whole, size - whole))
    pool = _Items(items)
    for context in (most >> k for k in range(tiers)):
        shortest = context == most >> tiers - 1
        # The items of this tier are longer than half its context; the shortest tier has all that are left.
        while pool.lengths and (shortest or 2 * pool.lengths[-1] > context):
            window = [pool.take(len(pool.lengths) - 1)]
            gap = context - window[0][2]
            while gap and pool.lengths:
                at = bisect_right(pool.lengths, gap) - 1
                if at >= 0:
                    window.append(pool.take(at))
                else:
                    # Nothing fits whole: the shortest is cut, and its end stays an item.
                    doc, start, n = pool.take(0)
                    window.append((doc, start, gap))
                    pool.add((doc, start + gap, n - gap))
                gap -= window[-1][2]
            if gap:
                left_open += window
            else:
                windows.append(window)
    return windows + _cut(left_open, _powers(sum(n for _, _, n in left_open), most))


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: the longest first, each to the group with the fewest ids so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    heapify(groups)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, group = groups[0]
        out[i] = group
        heapreplace(groups, (held + sizes[i], group))
    return out


def _shard(docs: list[tuple], first_sequence: int, first_step: int, most: int, tiers: int, step_tokens: int, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    windows = packed_windows([len(ids) for _, ids in docs], most, tiers)
    totals = [sum(n for _, _, n in w) for w in windows]
    steps = step_groups(totals, step_tokens)
    rows: list[tuple] = []
    for number, (window, total, step) in enumerate(zip(windows, totals, steps)):
        offset = 0
        for doc, start, n in window:
            doc_id, ids = docs[doc]
            rows.append((doc_id, start, n, len(ids), first_sequence + number, offset, total, first_step + step, ids[start:start + n].astype("<u4").tobytes()))
            offset += n
        if len(rows) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


_LONGS = ("start", "length", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_id")


def _packed(vocabulary: Vocabulary, most: int, tiers: int, shard_tokens: int, step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, small = _encoder(vocabulary), _library(vocabulary.path).get_vocab_size() <= 1 << 16
        task = TaskContext.get().partitionId() << 40
        sequence = step = task
        docs: list[tuple] = []
        held, kinds = 0, None

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, step, docs, held
            for out in _shard(docs, sequence, step, most, tiers, step_tokens, kinds):
                yield out
            # Numbers of the next shard begin beyond those of this one, whatever its windows.
            sequence, step = sequence + held, step + held
            docs, held = [], 0

        for batch in batches:
            kinds = kinds or pa.schema([("doc_id", batch.schema.field("doc_id").type), *((c, pa.int64()) for c in _LONGS), ("ids", pa.binary())])
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = encoder.ids(text.as_py())
                if docs and held + len(ids) > shard_tokens:
                    yield from full()
                docs.append((doc_id.as_py(), ids.astype("<u2") if small else ids))
                held += len(ids)
        if docs:
            yield from full()

    return run


def packed(docs: DataFrame, vocabulary: Vocabulary | None = None, most: int = MOST, tiers: int = TIERS, shard_tokens: int = SHARD_TOKENS,
           step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, sequence_tokens, step_id, ids (little-endian 32-bit numbers)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in _LONGS), T.StructField("ids", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(_packed(vocabulary or Vocabulary.word_bpe_49k(), most, tiers, shard_tokens, step_tokens), schema)


def pieces(packing: DataFrame) -> DataFrame:
    """The pieces of :func:`packed` with a checksum for their ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, step_id."""
    return packing.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "step_id")


def sequences(packing: DataFrame, pad_id: int = 0, most: int = MOST) -> DataFrame:
    """One row a sequence: sequence_id, step_id, ids (its pieces' one after the other, padded to ``most`` unless they are a power of two), doc_starts
    (where pieces begin)."""
    whole = packing.groupBy("sequence_id", "step_id", "sequence_tokens").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(bytearray()), lambda a, x: F.concat(a, x["ids"]))
    exact = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    padding = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), F.when(exact, 0).otherwise(F.lit(most) - F.col("sequence_tokens")).cast("int")))
    return whole.select("sequence_id", "step_id", F.concat(joined, padding).alias("ids"), F.col("p.offset").alias("doc_starts"))
