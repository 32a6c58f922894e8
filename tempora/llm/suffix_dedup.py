"""Suffix-array dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a ``length``-byte string that also starts earlier (in a document before it, or earlier in the same
one) is removed; matches never cross documents and are judged on the input.

The transform is cut into parts that can be sorted alone.  Each ``length``-byte window of a document has an anchor, its
least 32-byte gram by a scrambling hash; windows with equal bytes have equal anchors at equal places.  A run of
neighbouring windows with one anchor is a segment, and the segments of an anchor hold all windows that can be equal.

1. Anchors are counted over the corpus; a Bloom filter of ``BITMAP_BITS`` bits marks those that stand in two places or more (a
   false mark costs a transfer, nothing else).
2. Segments of marked anchors are shuffled by anchor.  Of segments with equal bytes only the first of a batch (or of some
   200,000 contents) is; the others are known to be repeated.  Anchors of more than ``hot`` places are dealt on by the contents of their single windows.
3. A task puts the distinct segments of some anchors into one text, sorts its suffixes by their first bytes and derives
   the common prefixes from the transform: intervals of suffixes with a common prefix of 8 bytes are extended backward,
   breadth first, and an interval whose right end is new has found a common prefix of that very value.  At ``length`` the
   expansion stops: suffixes not yet parted are equal windows, of which all but the first are repeated.
4. The repeated windows of each document become spans, which are joined to the texts (broadcast while they are counted to be
   few), and their bytes removed.

Defined cases: a null text counts as empty; documents come by doc_id, null last, and then by a hash of their text; rows
that repeat a doc_id and text are one document, with a result for each row; an empty table gives an empty result; other
columns are ignored, whatever their names.  Texts are UTF-8, in which no byte is 255.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import handed_over, mixed

LENGTH = 100
GRAM = 32
BITMAP_BITS = 1 << 26
PROBES = 3
PROBE_SHIFT = 18
HOT = 1 << 15
HOT_PARTS = 1 << 10
MARK = 255
_CHUNK = 1 << 20
#: Contents that a batch remembers at a time.
_KNOWN = 200_000
#: Removed spans that are broadcast to the texts; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
_TASK_BYTES = 1 << 20
_ODD = tuple(np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Documents put together up to about ``_CHUNK`` bytes; long ones in pieces that overlap by ``length - 1``.  Which
    documents, where each piece starts in its document, and the bytes, with a mark after each piece."""
    which, starts, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), _CHUNK):
            piece = text[at:at + _CHUNK + length - 1]
            which.append(i)
            starts.append(at)
            parts.append(piece)
            size += len(piece) + 1
            if size >= _CHUNK:
                yield which, starts, b"\xff".join([*parts, b""])
                which, starts, parts, size = [], [], [], 0
    if parts:
        yield which, starts, b"\xff".join([*parts, b""])


def segments(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Of each chunk: its bytes, and for each segment the document, the first window's start in document and chunk, the number of
    windows and the anchor."""
    for which, starts, data in _chunks(texts, length):
        x = np.frombuffer(data, np.uint8)
        words = np.ndarray(len(x) - 7, "<u8", data, strides=(1,))
        n = len(x) - GRAM + 1
        grams = mixed(sum((words[8 * i:8 * i + n] * odd for i, odd in enumerate(_ODD)), np.zeros(n, np.uint64)))
        # The least gram of each window, with its place in the low bits: of equal ones the leftmost.
        least, reach, span = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64), 1, length - GRAM + 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[:len(least) - (span - reach)], least[span - reach:])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        ends = np.flatnonzero(x == MARK)
        begins = np.concatenate([[0], ends[:-1] + 1])
        owner = np.repeat(np.arange(len(ends)), ends - begins + 1)[:len(place)]
        inside = np.arange(len(place)) + length <= ends[owner]
        new = inside & np.concatenate([[True], (place[1:] != place[:-1]) | ~inside[:-1]])
        first = np.flatnonzero(new)
        stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
        piece, at = owner[first], place[first]
        shift = np.asarray(starts)[piece] - begins[piece]
        yield data, np.asarray(which)[piece], first + shift, first, stop - first + 1, grams[at]


def _marked(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether all bits of an anchor are set: one in each of ``PROBES`` ranges of its own bits."""
    marked = np.ones(len(anchors), bool)
    for probe in range(PROBES):
        at = (anchors >> np.uint64(PROBE_SHIFT * probe) & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
        marked &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return marked


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            found = np.concatenate([*(s[-1] for s in segments(texts, length)), np.empty(0, np.uint64)])
            anchors, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(counts)], names=["anchor", "n"])

    return run


_COLUMNS = ("key", "part", "doc_hash", "start", "windows", "bytes")
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _order(doc_id, doc_hash) -> tuple:
    return doc_id is None, doc_id if doc_id is not None else 0, doc_hash


def _met(length: int, shared):
    """Segments of marked anchors, in the order of documents: the first of each content with its bytes, others without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = shared.value
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            docs = sorted(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_hash", "text"))), key=lambda d: _order(*d[:2]))
            known: dict[bytes, tuple] = {}
            rows: list[list] = [[] for _ in range(7)]
            again = [-1, 0, 0]  # the repeated windows at hand: document, start, number

            def add(*values) -> None:
                for column, value in zip(rows, values):
                    column.append(value)

            def put_again(doc: int, start: int, windows: int) -> None:
                if again[0] == doc and again[1] + again[2] == start:
                    again[2] += windows
                    return
                if again[0] >= 0:
                    doc_id, doc_hash, _ = docs[again[0]]
                    add(doc_id, again[1] ^ doc_hash, 0, doc_hash, again[1], again[2], None)
                again[:] = doc, start, windows

            def put(doc: int, start: int, windows: int, anchor: int, part: int, own: bytes) -> None:
                doc_id, doc_hash, _ = docs[doc]
                if known.setdefault(own, (doc_id, doc_hash, start)) != (doc_id, doc_hash, start):
                    put_again(doc, start, windows)  # known to be repeated: no need to meet the others
                else:
                    add(doc_id, anchor, part, doc_hash, start, windows, own)

            def flush():
                out = pa.RecordBatch.from_arrays([pa.array(rows[0], kind), *(pa.array(r, k) for r, k in zip(rows[1:], _KINDS))], names=["doc_id", *_COLUMNS])
                for column in rows:
                    column.clear()
                return out

            for data, *columns, anchors in segments([d[2] or b"" for d in docs], length):
                keep = _marked(bitmap, anchors)
                split = _marked(hot, anchors[keep])
                for doc, start, first, windows, anchor, apart in zip(*(c[keep].tolist() for c in columns), anchors[keep].view(np.int64).tolist(), split.tolist()):
                    if apart:
                        for i in range(windows):
                            own = data[first + i:first + i + length]
                            put(doc, start + i, 1, anchor, 1 + int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little") % HOT_PARTS, own)
                    else:
                        put(doc, start, windows, anchor, 0, data[first:first + windows + length - 1])
                if len(rows[0]) > 50_000:
                    yield flush()
                if len(known) > _KNOWN:
                    known.clear()
            put_again(-1, 0, 0)
            yield flush()

    return run


def equal_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts that stand in more than one place: text, start, and a number that equal windows share."""
    data = b"\xff".join([*texts, b""])
    x = np.frombuffer(data, np.uint8)
    n, q = len(x), 8
    marks = np.flatnonzero(x == MARK)
    mark_after = marks[np.searchsorted(marks, np.arange(n))]

    # Suffixes by their first 8 bytes, then by twice as many each round, as far as they aren't alone.  Each mark is a byte of its
    # own, in the order of the texts: what follows it doesn't count.
    keys = np.ndarray(n, ">u8", data + b"\xff" * q, strides=(1,)).astype(np.uint64)
    to_mark = mark_after - np.arange(n)
    keys &= ~np.uint64(0) << (8 * np.maximum(q - 1 - to_mark, 0)).astype(np.uint64)
    suffixes = np.argsort(keys, kind="stable")
    ordered, alone = keys[suffixes], (to_mark < q)[suffixes]
    parted = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | alone[1:] | alone[:-1], [True]])
    first_parted = parted.copy()
    rank = np.empty(n, np.int64)
    while True:
        group = np.maximum.accumulate(np.where(parted[:-1], np.arange(n), 0))
        rank[suffixes] = group
        together = np.flatnonzero(~(parted[:-1] & parted[1:]))
        if q >= length or not len(together):
            break
        members = suffixes[together]
        second = rank[members + q]
        by = np.lexsort((second, group[together]))
        suffixes[together], second = members[by], second[by]
        same = np.concatenate([[False], (second[1:] == second[:-1]) & (group[together][1:] == group[together][:-1])])
        parted[together] |= ~same
        q *= 2

    # The transform, and where each suffix's predecessor stands.
    place = np.empty(n, np.int64)
    place[suffixes] = np.arange(n)
    before, back = x[suffixes - 1], place[suffixes - 1]

    # Breadth-first backward extension: intervals of common prefixes of 8, 9, ... bytes.
    found = first_parted
    left = np.flatnonzero(found[:-1])
    right = np.concatenate([left[1:], [n]])
    for _ in range(8, length):
        one = right - left == 1
        alone = left[one]
        alone = back[alone[before[alone] != MARK]]
        low, high = [alone], [alone + 1]
        if not one.all():
            widths = (right - left)[~one]
            inside = np.arange(widths.sum()) + np.repeat(left[~one] - np.cumsum(widths) + widths, widths)
            key = np.repeat(np.arange(len(widths)), widths) * 256 + before[inside]
            inside, key = inside[before[inside] != MARK], key[before[inside] != MARK]
            by = np.argsort(key, kind="stable")
            key, to = key[by], back[inside[by]]
            if len(key):
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                low.append(np.minimum.reduceat(to, starts))
                high.append(np.maximum.reduceat(to, starts) + 1)
        left, right = np.concatenate(low), np.concatenate(high)
        new = ~found[right]
        left, right = left[new], right[new]
        if not len(right):
            break
        found[right] = True
    groups = np.cumsum(found[:-1])
    repeated = np.flatnonzero(~(found[:-1] & found[1:]))
    start = suffixes[repeated]
    text = np.searchsorted(marks, start)
    return text, start - np.concatenate([[0], marks[:-1] + 1])[text], groups[repeated]


def _repeated(group: list[tuple], length: int) -> Iterator[tuple]:
    """Of the segments (key, doc_id, doc_hash, start, windows, bytes) of some anchors, the repeated windows as (doc_id, doc_hash, start, windows)."""
    group.sort(key=lambda s: (*_order(s[1], s[2]), s[3]))
    first: dict[bytes, tuple] = {}
    contents: dict[tuple, int] = {}
    for s in group:
        if (own := first.setdefault(s[5], s)) is not s:
            if own[1:4] != s[1:4]:
                yield s[1], s[2], s[3], s[4]
        else:
            contents[s[0]] = contents.get(s[0], 0) + 1
    # Only an anchor with several contents can have further equal windows.
    left = [s for s in first.values() if contents[s[0]] > 1]
    if not left:
        return
    text, start, same = equal_windows([s[5] for s in left], length)
    # Segments are in order, and equal windows have equal distances from their anchors: the first is that of the first segment.
    by = np.lexsort((text, same))
    text, start, same = text[by], start[by], same[by]
    head = np.concatenate([[True], same[1:] != same[:-1]])
    earliest = text[np.maximum.accumulate(np.where(head, np.arange(len(text)), 0))]
    again = text > earliest
    text, start = text[again], start[again]
    by = np.lexsort((start, text))
    text, start = text[by], start[by]
    if len(text):
        heads = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)]))
        for i, at, windows in zip(text[heads].tolist(), start[heads].tolist(), np.diff(np.append(heads, len(text))).tolist()):
            yield left[i][1], left[i][2], left[i][3] + at, windows


def _expanded(length: int):
    """Anchors come one after the other; whole ones are taken together up to about ``_TASK_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, group, size, now = None, [], [], 0, None

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((kind, pa.int64(), pa.int64(), pa.int64()))],
                                               names=["doc_id", "doc_hash", "start", "windows"])
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, key, part, doc_hash, start, windows, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *_COLUMNS))):
                if own is None:
                    out.append((doc_id, doc_hash, start, windows))
                    continue
                if size >= _TASK_BYTES and (key, part) != now:
                    out += _repeated(group, length)
                    group, size = [], 0
                now = (key, part)
                group.append((now, doc_id, doc_hash, start, windows, own))
                size += len(own)
            if out:
                yield flush()
        if group:
            out += _repeated(group, length)
        if out:
            yield flush()

    return run


def _spans(length: int):
    """The windows of a document as maximal spans (start, stop) of covered bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for windows in batch.column("windows").to_pylist():
                spans: list[dict] = []
                for start, stop in sorted((w["start"], w["start"] + w["windows"] - 1 + length) for w in windows):
                    if spans and start <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(spans[-1]["stop"], stop)
                    else:
                        spans.append({"start": start, "stop": stop})
                found.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc_hash"), pa.array(found, kind)], names=["doc_id", "doc_hash", "spans"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            text, spans = text or b"", spans or []
            edges = [0, *(e for span in spans for e in (span["start"], span["stop"])), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((doc_id, len(text), len(text) - len(kept), len(spans), kept))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, doc_hash, start, windows: runs of windows of ``length`` bytes that also start earlier."""
    texts = _hashed(docs)
    counts = texts.select("text").mapInArrow(_anchors(length), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    counts = counts.select("n", F.explode(F.array(*(F.expr(f"shiftrightunsigned(anchor, {PROBE_SHIFT * probe}) & {BITMAP_BITS - 1}L") for probe in range(PROBES)))).alias("bit"))
    bit = F.col("bit") + 1
    bits = (counts.groupBy(F.bitmap_bucket_number(bit).alias("bucket"), (F.col("n") > hot).alias("hot"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect())
    bitmap, hot_bitmap = (np.zeros(BITMAP_BITS // 8, np.uint8) for _ in range(2))
    for row in bits:
        own = slice((row.bucket - 1) * 4096, row.bucket * 4096)
        bitmap[own] |= np.frombuffer(row.bits, np.uint8)
        if row.hot:
            hot_bitmap[own] |= np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, hot_bitmap if hot_bitmap.any() else np.zeros(1, np.uint8)))
    longs = [T.StructField(c, T.LongType()) for c in _COLUMNS[:-1]]
    met = texts.mapInArrow(_met(length, shared), T.StructType([docs.schema["doc_id"], *longs, T.StructField("bytes", T.BinaryType())]))
    dealt = met.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_expanded(length), T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("doc_hash", "start", "windows"))]))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.col("text").cast("binary").alias("text"))


def deduplicated(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that are left)."""
    windows = repeats(docs, length, hot).groupBy("doc_id", "doc_hash").agg(F.collect_set(F.struct("start", "windows")).alias("windows"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    kinds = T.StructType([docs.schema["doc_id"], T.StructField("doc_hash", T.LongType()), T.StructField("spans", span)])
    spans = handed_over(windows.mapInArrow(_spans(length), kinds), "spans")
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("doc_hash").alias("_hash"), "spans")
    if (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= MOST_BROADCAST:
        spans = F.broadcast(spans)
    texts = _hashed(docs)
    joined = texts.join(spans, texts["doc_id"].eqNullSafe(spans["_doc"]) & (texts["doc_hash"] == spans["_hash"]), "left").select("doc_id", "text", "spans")
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(_removed, schema)
