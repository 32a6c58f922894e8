"""Importance resampling towards a target distribution, with weights by bit-sliced aggregation.

A document's features are its runs of 1 to ``longest_run`` words, in ``buckets`` classes by CRC-32.  A bucket's gain compares the
smoothed share of the target table's features in it with that of all documents; a document's weight is the floored mean
gain of its features.

*Bit-sliced.*  A document's counts per bucket become planes, one a binary digit: bit b of plane i is digit i of the count of
bucket b.  The gains, which are whole numbers, become planes of their positive and of their negative amounts.  The sum of all gains of a document is
the sum over pairs of planes of ``2**(i + j) * popcount(counts_i AND gains_j)``, positive minus negative: exact whole numbers, without a
multiplication per feature.  A document has as many planes as its largest count has digits, and rows are worked off in blocks of
``BLOCK_WORDS`` machine words, so a task's memory doesn't grow with its rows.

Counts are taken from whole texts, in pieces of ``CHUNK`` bytes cut between words, and written once as sparse lists; the totals per bucket
are added up within tasks first and are ``buckets`` numbers on the driver, whatever the corpus holds.

*Draw.*  Weights get Gumbel noise from a hash of the doc_id, and the highest scores are drawn (sampling without
replacement).  Ranks come from ranges of scores (:func:`shared.numbered`), so no task has more than a range of them.

Defined cases: null and empty texts have no features and weight 0; a null doc_id has the hash of its seed alone; rows that
share a doc_id are documents of their own, with the same noise; ties of score and doc_id are in the order of weight, then features; an empty
target gives all buckets the smoothing alone; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import handed_over, numbered

BUCKETS = 10_000
LONGEST_RUN = 1
CHUNK = 1 << 20
BLOCK_WORDS = 1 << 20
#: Lower-cases A-Z; what is neither a letter nor a digit nor beyond ASCII becomes a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def feature_counts(text: str | None, longest_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets that a text's features fall in, in order, how many fall in each, and the number of its words."""
    data = (text or "").encode().translate(_WORD_BYTES)
    total, before, words_seen, at = np.zeros(buckets, np.int64), [], 0, 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        at, words_seen = end, words_seen + len(words)
        found = Counter(words)
        # Longer runs may begin in the piece before.
        joined = before + words
        for n in range(2, longest_run + 1):
            first = max(0, len(before) - n + 1)
            found.update(b" ".join(joined[i:i + n]) for i in range(first, len(joined) - n + 1))
        before = joined[len(joined) - longest_run + 1:] if longest_run > 1 else []
        if found:
            where = np.fromiter((zlib.crc32(f) % buckets for f in found), np.int64, len(found))
            np.add.at(total, where, np.fromiter(found.values(), np.int64, len(found)))
    held = np.flatnonzero(total)
    return held, total[held], words_seen


def _counted(longest_run: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = [feature_counts(t, longest_run, buckets) for t in batch.column("text").slice(at, 1000).to_pylist()]
                held, counts, words = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 1000), pa.array(words, pa.int64()),
                                                  pa.array([h.astype("<u4").tobytes() for h in held], pa.binary()),
                                                  pa.array([c.astype("<u4").tobytes() for c in counts], pa.binary())], names=["doc_id", "n_words", "held", "counts"])

    return run


def counted(docs: DataFrame, longest_run: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, and its buckets (``held``) and their counts as little-endian 32-bit numbers."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("held", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    return docs.select("doc_id", "text").mapInArrow(_counted(longest_run, buckets), schema)


def _totals(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held, counts in zip(batch.column("held").to_pylist(), batch.column("counts").to_pylist()):
                total[np.frombuffer(held, "<u4")] += np.frombuffer(counts, "<u4")
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), pa.array(total[where])], names=["bucket", "n"])

    return run


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows of ``counted()`` are in each bucket."""
    sums = counts.select("held", "counts").mapInArrow(_totals(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in sums:
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of the ratio of both smoothed shares, floored."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.asarray([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def planes(values: np.ndarray, digits: int) -> np.ndarray:
    """Rows of non-negative numbers as (row, digit, 64-bit words): bit b of plane i is digit i of number b."""
    wide = np.zeros((len(values), -(-values.shape[1] // 64) * 64), np.int64)
    wide[:, :values.shape[1]] = values
    bits = (wide[:, None, :] >> np.arange(digits)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def _digits(most: int) -> int:
    return max(1, int(most).bit_length())


def sliced_sums(counts: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """For each row of planes of counts, the sum of count times gain over all buckets."""
    out = np.zeros(len(counts), np.int64)
    for i in range(counts.shape[1]):
        for sign, amounts in ((1, positive), (-1, negative)):
            for j, plane in enumerate(amounts):
                out += sign * (np.bitwise_count(counts[:, i] & plane).sum(axis=1, dtype=np.int64) << (i + j))
    return out


def noise(seed: int, doc_id) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weighed(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        amounts = [np.maximum(gain, 0), np.maximum(-gain, 0)]
        positive, negative = (planes(a[None], _digits(a.max(initial=0)))[0] for a in amounts)
        for batch in batches:
            ids, held, counts = (batch.column(c).to_pylist() for c in ("doc_id", "held", "counts"))
            most = [int(np.frombuffer(c, "<u4").max(initial=0)) for c in counts]
            features = [int(np.frombuffer(c, "<u4").sum(dtype=np.int64)) for c in counts]
            sums = np.zeros(len(ids), np.int64)
            # Rows of as many digits go together.
            order = sorted(range(len(ids)), key=lambda r: _digits(most[r]))
            at = 0
            while at < len(order):
                digits = _digits(most[order[at]])
                block = order[at:at + max(1, BLOCK_WORDS // (64 * digits * len(positive[0])))]
                block = [r for r in block if _digits(most[r]) == digits]
                dense = np.zeros((len(block), len(gain)), np.int64)
                for k, r in enumerate(block):
                    dense[k, np.frombuffer(held[r], "<u4")] = np.frombuffer(counts[r], "<u4")
                sums[block] = sliced_sums(planes(dense, digits), positive, negative)
                at += len(block)
            weights = [int(s) // n if n else 0 for s, n in zip(sums.tolist(), features)]
            scores = [w + noise(seed, i) for w, i in zip(weights, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(v, pa.int64()) for v in (features, weights, scores))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest_run: int = LONGEST_RUN,
              buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (from 1; null if not drawn).

    Drawn are ``percent`` of a hundred of the documents with at least ``least_words`` words; ``target`` needs a column ``text``.
    """
    counts = handed_over(counted(docs, longest_run, buckets), "feature-counts")
    wanted = counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest_run, buckets)
    shared = docs.sparkSession.sparkContext.broadcast(gains(totals(counts, buckets), totals(wanted, buckets)))
    schema = T.StructType([counts.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    weighed = handed_over(counts.mapInArrow(_weighed(shared, seed), schema), "weighed")
    eligible = weighed.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    ranked = numbered(eligible, "scores", F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"))
    out = ("doc_id", "n_features", "weight", "score")
    rank = F.when(F.col("number") < drawn, F.col("number") + 1)
    return ranked.select(*out, rank.alias("rank")).unionAll(weighed.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
