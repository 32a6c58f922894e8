"""N-gram Jaccard self join with filters under several global orders.

A document is its set of distinct k-word shingles, as 64-bit numbers.  Under any order of all shingles, two sets of
Jaccard similarity ``percent`` or more share a shingle among the first ``n - ceil(n * percent / 100) + 1`` of each.
Each of ``ORDERS`` orders scrambles the shingles in its own way, but puts those that are frequent in the corpus last, so
that few documents meet by common passages.  Candidates must meet under every order:

1. equal sets are folded into one (its least doc_id stands for all), so copies never meet each other;
2. prefixes under the first order are shuffled; buckets of one document go, then buckets with the members of another one;
   buckets are split by size, as similar sets have similar sizes;
3. within a bucket the filters of all orders are intersected: prefixes must meet under each, and the shingles they show to be
   missing in the other set must not be too many.  A bucket gives the pairs that are left or, if they are more than
   ``PAIRS_A_MEMBER`` times its members (near copies of one text), its members: no task emits all pairs (the second filter is
   left out where more than ``OPEN_PAIRS_A_MEMBER`` times its members pass the first).  A bucket with more than
   ``GROUP_SHINGLES`` shingles is dealt over several tasks, by pairs of parts;
4. pairs are verified exactly on their full sets; a dense group is verified as a whole, from lists of who has which shingle, and only
   links that connect something new, fewer than its members, leave its task;
5. links become components by distributed star steps.

What is frequent is a sketch of constant size: a table of ``SLOTS`` classes, a shingle's slot being its last bits.  Counted are, over
all documents, the shingles that are low in the first scrambled order (``COUNTED`` times the share that prefixes take: those
that can come first) and all that stand twice in a batch of rows.  Any order gives the same result, so the sketch decides
the speed alone.

Defined cases: null and empty texts and those without words have no shingles, link with nothing and are their own component; a
text of fewer than k words is one shingle, its word sequence; rows that share a doc_id are one document (linked if any of its
rows is); a null doc_id has a null component and links with nothing; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import handed_over, in_small_batches, mixed, removed, short_lived_shuffles

ORDERS = 3
SLOTS = 1 << 24
LEVELS = 12
COUNTED = 2
COUNTED_TOGETHER = 4_000_000
GROUP_SHINGLES = 2_000_000
MOST_BROADCAST = 1_000_000
PAIRS_A_MEMBER = 4
OPEN_PAIRS_A_MEMBER = 64
_SEEDS = tuple(np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_CHUNK = 1 << 22
#: Longer words are hashed one by one, others together, eight bytes at a time.
_LONG_WORD = 64


def _word_numbers(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word, from its bytes and length."""
    blocks = np.ndarray(len(data), "<u8", data + b"\0" * 8, strides=(1,))
    numbers = mixed(lengths.astype(np.uint64) * _SEEDS[4])
    left, at = np.arange(len(starts)), 0
    while len(left):
        rest = np.minimum(lengths[left] - at, 8).astype(np.uint64)
        own = blocks[starts[left] + at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * rest))
        numbers[left] = mixed(numbers[left] * _SEEDS[1] + own)
        at += 8
        left = left[(lengths[left] > at) & (lengths[left] <= _LONG_WORD)]
    for i in np.flatnonzero(lengths > _LONG_WORD).tolist():
        numbers[i] = int.from_bytes(blake2b(data[starts[i]:starts[i] + lengths[i]], digest_size=8).digest(), "little")
    return numbers


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The numbers of the distinct shingles of each text, in order."""
    found, chunk, size = [], [], 0
    for text in texts:
        chunk.append((text or "").encode().lower())
        size += len(chunk[-1])
        if size > _CHUNK:
            found += _chunk_sets(chunk, k)
            chunk, size = [], 0
    return found + _chunk_sets(chunk, k)


def _chunk_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    data = b" ".join([*texts, b""])
    white = _WHITE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(data) and not white[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    numbers = _word_numbers(data, starts, ends - starts)
    # How many words stand before the end of each text.
    last = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    first = np.concatenate([[0], last[:-1]]).astype(np.int64)
    whole = np.full(max(0, len(numbers) - k + 1), k, np.uint64)
    for i in range(k):
        whole = mixed(whole * _SEEDS[0] + numbers[i:len(numbers) - k + 1 + i])
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= k:
            out.append(np.unique(whole[a:b - k + 1]))
        else:
            one = np.full(min(1, b - a), b - a, np.uint64)
            for i in range(a, b):
                one = mixed(one * _SEEDS[0] + numbers[i:i + 1])
            out.append(one)
    return out


@dataclass(frozen=True)
class Orders:
    """Global orders of all shingles: by the class of their slot, frequent ones last, and scrambled within a class."""

    percent: int
    classes: np.ndarray

    def ranks(self, shingles: np.ndarray, order: int) -> np.ndarray:
        """Where shingles stand under an order; equal ranks are in the order of the shingles."""
        slots = (shingles & np.uint64(len(self.classes) - 1)).astype(np.int64)
        return mixed(shingles ^ _SEEDS[order]) >> np.uint64(6) | self.classes[slots].astype(np.uint64) << np.uint64(58)

    def prefix(self, ordered: np.ndarray, order: int) -> np.ndarray:
        """What two sets of the wanted similarity must share a shingle of."""
        n = len(ordered)
        return ordered[np.argsort(self.ranks(ordered, order), kind="stable")[:n - -(-n * self.percent // 100) + 1]]

    def least_common(self, m: int, n: int) -> int:
        """How many shingles sets of m and n must share."""
        return -(-self.percent * (m + n) // (100 + self.percent))

    def views(self, prefixes: list[list[np.ndarray]]) -> list[list[tuple]]:
        """Of each set's prefixes, under each order: the shingles in their order, their ranks, and the shingles as a set."""
        ends = [np.cumsum([len(p[order]) for p in prefixes])[:-1] for order in range(ORDERS)]
        ranks = [np.split(self.ranks(np.concatenate([p[order] for p in prefixes]), order), ends[order]) for order in range(ORDERS)]
        return [[(t := p[order].tolist(), ranks[order][i].tolist(), set(t)) for order in range(ORDERS)] for i, p in enumerate(prefixes)]

    def passes(self, m: int, n: int, one: list[tuple], other: list[tuple]) -> bool:
        """The intersected filters of all orders, for sets of m and n shingles: prefixes must meet under each order, and what
        they show to be missing in the other set, counted over all orders, must not be too much."""
        missing_there, missing_here = set(), set()
        for (p, ranks_p, in_p), (q, ranks_q, in_q) in zip(one, other):
            if in_p.isdisjoint(in_q):
                return False
            # Below the end of both prefixes, what isn't in the other's prefix isn't in the other set.
            end = min(ranks_p[-1], ranks_q[-1])
            missing_there.update(in_p.difference(in_q).intersection(p[:bisect_left(ranks_p, end)]))
            missing_here.update(in_q.difference(in_p).intersection(q[:bisect_left(ranks_q, end)]))
        need = self.least_common(m, n)
        return m - len(missing_there) >= need and n - len(missing_here) >= need


def _counted(k: int, percent: int):
    low = np.uint64(min(2 ** 64 - 1, 2 ** 64 * COUNTED * (100 - percent) // 100))

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
        kept = (counts > 1) | (mixed(found ^ _SEEDS[0]) < low)
        return pa.RecordBatch.from_arrays([pa.array(found[kept].view(np.int64)), pa.array(counts[kept])], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches are bounded in bytes; what is counted together is bounded in shingles, so copies meet here and not in the shuffle.
        sets: list[np.ndarray] = []
        for batch in batches:
            sets += shingle_sets(batch.column("text").to_pylist(), k)
            if sum(map(len, sets)) >= COUNTED_TOGETHER:
                yield counted(sets)
                sets = []
        yield counted(sets)

    return run


def orders(docs: DataFrame, k: int, percent: int) -> Orders:
    """A class for each slot, from the count of its most frequent shingle: 0 for 1, 1 for 2 and 3, one more for each power of 4."""
    counts = docs.select("text").mapInArrow(_counted(k, percent), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    level = F.least(1 + F.floor(F.log2(F.col("n").cast("double")) / 2 + 1e-9), F.lit(LEVELS)).cast("int")
    slot = F.expr(f"shingle & {SLOTS - 1}L") + 1
    marks = (counts.where("n > 1").select(level.alias("level"), F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit"))
             .groupBy("level", "part").agg(F.bitmap_construct_agg("bit").alias("bits")))
    classes = np.zeros(SLOTS, np.uint8)
    for row in marks.orderBy("level").collect():
        own = classes[(row.part - 1) * 32768:row.part * 32768]
        own[np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")[:len(own)] > 0] = row.level
    return Orders(percent, classes)


def _profile(k: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            # Two sums of scrambled members, and the size, tell sets apart.
            a, b = (np.asarray([mixed(s ^ seed).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64) for seed in _SEEDS[-2:])
            prefixes = [shared.value.prefix(s, 0).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.array(prefixes, pa.list_(pa.int64()))],
                                             names=["doc_id", "n", "a", "b", "prefix"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _prefixes(k: int, shared):
    """Size of the set, and the prefixes under all orders, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            joined = [b"".join(shared.value.prefix(s, order).tobytes() for order in range(ORDERS)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(joined, pa.binary())],
                                             names=["rep", "size", "prefixes"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], values: tuple[str, ...], act) -> Iterator[pa.RecordBatch]:
    """Groups of rows come one after the other; only the one at hand is held."""
    now, group = None, []
    for batch in batches:
        for key, row in zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*(batch.column(c).to_pylist() for c in values))):
            if key != now:
                if len(group) > 1:
                    yield from act(now, group)
                now, group = key, []
            group.append(row)
    if len(group) > 1:
        yield from act(now, group)


_GROUP = ("bucket", "class", "low", "high")


def _candidates(shared, id_kind: pa.DataType):
    """Of each group, the pairs that pass the filters of all orders; of a group in which pairs are more than
    ``PAIRS_A_MEMBER`` times the members, the members instead (rep, part), for a verification as a whole."""

    def act(key: tuple, group: list) -> Iterator[pa.RecordBatch]:
        by: Orders = shared.value
        reps, sizes, raw, parts = zip(*group)
        prefixes = [np.split(np.frombuffer(r, np.uint64), ORDERS) for r in raw]
        m, size, part, number = len(group), np.asarray(sizes), np.asarray(parts), {}
        same = np.asarray([number.setdefault(r, len(number)) for r in reps])
        indexes = [_Index([p[order] for p in prefixes]) for order in range(ORDERS)] if m > 8 else []
        open_pairs: list = []
        for i in range(m - 1):
            open_ = (np.arange(m) > i) & (same != same[i]) & (100 * np.minimum(size, size[i]) >= by.percent * np.maximum(size, size[i]))
            if part.any() and (part != part[0]).any():
                open_ &= part != part[i]
            for index in indexes:
                if open_.any():
                    open_ &= index.shared(i) > 0
            open_pairs += ((i, j) for j in np.flatnonzero(open_).tolist())
            if len(open_pairs) > OPEN_PAIRS_A_MEMBER * m:
                break
        most, pairs = PAIRS_A_MEMBER * m, []
        if dense := len(open_pairs) > OPEN_PAIRS_A_MEMBER * m:
            open_pairs = []
        views = by.views(prefixes) if open_pairs else []
        for i, j in open_pairs:
            if by.passes(sizes[i], sizes[j], views[i], views[j]):
                pairs.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
                if dense := len(pairs) > most:
                    break
        if dense:
            rows = [(*key, r, p, None) for r, p in zip(reps, parts)]
        else:
            rows = [(None, None, None, None, a, None, b) for a, b in pairs]
        if rows:
            kinds = (*(pa.int64(),) * 4, id_kind, pa.int64(), id_kind)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*_GROUP, "rep", "part", "partner"])

    return lambda batches: _grouped(batches, _GROUP, ("rep", "size", "prefixes", "part"), act)


def _pairs_verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for raw_a, raw_b in zip(batch.column("shingles").to_pylist(), batch.column("partner_shingles").to_pylist()):
                a, b = np.frombuffer(raw_a, np.uint64), np.frombuffer(raw_b, np.uint64)
                common = len(np.intersect1d(a, b, True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("rep").filter(keep), batch.column("partner").filter(keep)], names=["a", "b"])

    return run


class _Index:
    """Who has which shingle, among the members of a group."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = len(sets)
        lengths = [len(s) for s in sets]
        self.ends = np.cumsum([0, *lengths])
        found, self.numbers, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.owners = np.repeat(np.arange(len(sets)), lengths)[np.argsort(self.numbers, kind="stable")]
        self.starts = np.cumsum(np.concatenate([[0], counts]))

    def shared(self, member: int) -> np.ndarray:
        """How many shingles of ``member`` each member has."""
        numbers = self.numbers[self.ends[member]:self.ends[member + 1]]
        first, last = self.starts[numbers], self.starts[numbers + 1]
        return np.bincount(np.concatenate([self.owners[s:e] for s, e in zip(first.tolist(), last.tolist())]), minlength=self.size)


def group_links(reps: list, sets: list[np.ndarray], parts: list[int], by: Orders) -> list[tuple]:
    """Links between members of one dense group that join what wasn't connected: the filters of the further orders are
    intersected, then sizes of intersections verified.  With two parts only pairs across them count."""
    m, sizes, part = len(reps), np.asarray([len(s) for s in sets]), np.asarray(parts)
    filters = [_Index([by.prefix(s, order) for s in sets]) for order in range(1, ORDERS)]
    whole, label, found = _Index(sets), np.arange(m), []
    for i in range(m - 1):
        small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
        open_ = (np.arange(m) > i) & (label != label[i]) & (100 * small >= by.percent * large)
        if part.any() and not part.all():
            open_ &= part != part[i]
        for index in filters:
            if open_.any():
                open_ &= index.shared(i) > 0
        if not open_.any():
            continue
        both = whole.shared(i)
        for j in np.flatnonzero(open_ & (100 * both >= by.percent * (sizes + sizes[i] - both))).tolist():
            if label[j] != label[i]:
                found.append((reps[i], reps[j]))
                label[label == label[j]] = label[i]
    return found


def _groups_verified(shared, id_kind: pa.DataType):
    def act(key: tuple, group: list) -> Iterator[pa.RecordBatch]:
        reps, sets, parts = zip(*group)
        first = min(parts)
        found = group_links(list(reps), [np.frombuffer(s, np.uint64) for s in sets], [int(p != first) for p in parts], shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], id_kind) for i in (0, 1)], names=["a", "b"])

    return lambda batches: _grouped(batches, _GROUP, ("rep", "shingles", "part"), act)


def similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    with short_lived_shuffles(docs.sparkSession):
        return _similar(docs, k, percent)


def _similar(docs: DataFrame, k: int, percent: int) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    base = in_small_batches(docs).select("doc_id", "text")
    shared = spark.sparkContext.broadcast(orders(base, k, percent))

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "a", "b")), T.StructField("prefix", T.ArrayType(T.LongType()))])
    profile = handed_over(base.mapInArrow(_profile(k, shared), schema), "profile")
    with_words = profile.where("n > 0 AND doc_id IS NOT NULL")

    # Buckets of the first order: how many sets, and which (a checksum of the members).
    one = with_words.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    postings = one.select("rep", "n", F.explode("prefix").alias("bucket"))
    members_of = [F.bit_xor(F.xxhash64("rep", "n", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    shared_by_some = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *members_of).where("size > 1")
    buckets = shared_by_some.groupBy("size", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket")
    met = handed_over(postings.join(buckets, "bucket"), "met")
    # Sets of similar sizes are in one class or in neighbouring ones (classes are a hair wider, against rounding).
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent * (1 + 1e-9))))
    classed = met.withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    groups = classed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), *members_of).where("size > 1")
    groups = groups.groupBy("size", "weight", "x0", "x1").agg(F.min(F.struct("bucket", "class")).alias("g")).select("g.*", "weight")
    groups = groups.select("bucket", "class", F.ceil(F.col("weight") / GROUP_SHINGLES).alias("parts"))
    member = handed_over(classed.join(groups, ["bucket", "class"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts"))), "members")
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("bucket", "class", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "rep", "part")

    # The filters of all orders, on the prefixes of the documents that met another.
    id_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    rep = T.StructField("rep", kind)

    wanted = []

    def of_documents(reps: DataFrame, make, *fields: T.StructField) -> DataFrame:
        """What ``make`` derives from the texts of some documents; ids are broadcast while they are few."""
        reps = handed_over(reps.distinct(), "wanted")
        wanted.append(reps)
        known = F.broadcast(reps) if reps.count() <= MOST_BROADCAST else reps
        return base.join(known, base["doc_id"] == known["rep"], "left_semi").mapInArrow(make, T.StructType([rep, *fields]))

    prefixes = of_documents(member.select("rep"), _prefixes(k, shared), T.StructField("size", T.LongType()), T.StructField("prefixes", T.BinaryType()))
    tasks = dealt.join(prefixes, "rep").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "rep")
    longs = [T.StructField(c, T.LongType()) for c in _GROUP]
    passed = T.StructType([*longs, rep, T.StructField("part", T.LongType()), T.StructField("partner", kind)])
    candidates = handed_over(tasks.select(*_GROUP, "rep", "size", "prefixes", "part").mapInArrow(_candidates(shared, id_kind), passed), "candidates")
    removed(met, member)
    pairs = candidates.where("partner IS NOT NULL").select("rep", "partner").distinct()
    dense = candidates.where("partner IS NULL").drop("partner").distinct()

    # Verification on the full sets of the candidates.
    asked = dense.select("rep").unionAll(pairs.select("rep")).unionAll(pairs.select(F.col("partner").alias("rep")))
    sets = handed_over(of_documents(asked, _sets(k), T.StructField("shingles", T.BinaryType())), "sets")
    links_kind = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    partners = sets.select(F.col("rep").alias("partner"), F.col("shingles").alias("partner_shingles"))
    both = pairs.join(sets, "rep").join(partners, "partner").select("rep", "partner", "shingles", "partner_shingles")
    links = both.mapInArrow(_pairs_verified(percent), links_kind)
    whole = dense.join(sets, "rep").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "rep")
    links = links.unionAll(whole.select(*_GROUP, "rep", "shingles", "part").mapInArrow(_groups_verified(shared, id_kind), links_kind))

    # Rows that share a doc_id are one document.
    several = with_words.groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")).where("low <> high").select("doc_id")
    stands_for = one.select(F.col("n").alias("_n"), F.col("a").alias("_a"), F.col("b").alias("_b"), "rep")
    own = with_words.join(several, "doc_id").join(stands_for, (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    found = handed_over(components(links.unionAll(own.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))), "components")

    stands_for = handed_over(with_words.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
                             .join(found, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("_n"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.coalesce("component", "rep").alias("component_id")), "sets_components")
    joined = profile.select("doc_id", "n", "a", "b").join(stands_for, (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their component, and those without a doc_id."""
    stays = similar(docs, k, percent).where("doc_id = component_id").select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stays, docs["doc_id"] == stays["stays"], "left_semi").unionAll(docs.where("doc_id IS NULL"))
