"""Exact dedup by deterministic block naming.

A normalised text (white space deleted) is cut into blocks of a fixed number of bytes.  Equal blocks get one
integer name, found by sorting the distinct blocks; then adjacent names are paired and each distinct pair gets an
integer name, again and again, until a document has one name.  Two documents have the same name and the same
number of blocks exactly if their normalised texts are equal: names come from sorted contents, never from a digest,
so there are no collisions.

Copies that stand in one Arrow batch are folded into one entry before anything is shuffled, so a text that holds a
third of all rows reaches the naming step as one entry a batch.  Sorting is done within 2**20 buckets of content (a
name is ``rank in its bucket * 2**20 + bucket``), so no task sorts more than a few buckets; a block that many different texts
share (a common header) is one row there.

Defined cases: a null text counts as empty, and all empty texts are copies of each other; a null doc_id is an
ordinary row that loses every tie; rows that repeat a doc_id are rows of their own, and of equal rows one stays;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import handed_over, in_small_batches

WHITE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1024
BUCKETS = 1 << 20
FREQUENT = 10_000
#: Names of a kilobyte each are broadcast while they are no more.
MOST_BROADCAST = 8192


def _entries(block_bytes: int):
    """Of each batch: one entry a distinct normalised text, as rows (entry, n_blocks, idx, block); row 0 has the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = TaskContext.get().partitionId() << 36
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            found: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                found.setdefault(text.encode().translate(None, WHITE), []).append((-len(text), doc_id is None, doc_id or 0, doc_id))
            rows: dict[str, list] = {k: [] for k in ("entry", "n_blocks", "idx", "block", "ids", "best", "longest", "digest")}
            for norm, members in found.items():
                members.sort(key=lambda m: m[:3])
                n = max(1, -(-len(norm) // block_bytes))
                rows["entry"] += [entry] * n
                rows["n_blocks"] += [n] * n
                rows["idx"] += range(n)
                rows["block"] += [norm[i * block_bytes:(i + 1) * block_bytes] for i in range(n)]
                for name, value in (("ids", [m[3] for m in members]), ("best", members[0][3]), ("longest", -members[0][0]),
                                    ("digest", hashlib.sha256(norm).hexdigest())):
                    rows[name] += [value] + [None] * (n - 1)
                entry += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(kind), kind, pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    return cut


def _named(frame: DataFrame, *content: str) -> DataFrame:
    """Replace the content columns by an integer ``name``, the same for equal contents only.

    Contents of hashes that more than ``FREQUENT`` rows have are made distinct before they are ranked, within tasks first, and their
    (negative) names are joined back; the rows of all others are ranked where they are.
    """
    hashed = frame.withColumn("_hash", F.xxhash64(*content))
    bucket = F.pmod(F.col("_hash"), F.lit(BUCKETS))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*content))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket).withColumn("name", rank * F.lit(BUCKETS) + F.col("bucket")).drop("bucket")

    frequent = handed_over(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT).select(F.col("_hash").alias("often")), "frequent")
    n = frequent.count()
    if not n:
        return ranked(hashed).drop("_hash", *content)
    # Read twice from here on: entries are numbered once.
    hashed = handed_over(hashed, "contents")
    known = F.broadcast(frequent) if n <= MOST_BROADCAST else frequent
    rare = ranked(hashed.join(known, F.col("_hash") == F.col("often"), "left_anti")).drop("_hash", *content)
    rows = hashed.join(known, F.col("_hash") == F.col("often"), "left_semi")
    names = handed_over(ranked(rows.select("_hash", *content).distinct()).select(*(F.col(c).alias(f"_{c}") for c in content), (-F.col("name")).alias("name")), "names")
    named = F.broadcast(names) if n <= MOST_BROADCAST else names
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in content))
    return rare.unionByName(rows.join(named, same).select(*rare.columns))


def duplicate_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("entry", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("idx", T.LongType()),
                           T.StructField("block", T.BinaryType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("best", kind),
                           T.StructField("longest", T.LongType()), T.StructField("digest", T.StringType())])
    cut = in_small_batches(docs).select("doc_id", "text").mapInArrow(_entries(block_bytes), schema)
    blocks = handed_over(_named(cut, "block"), "blocks")

    # Names of pairs, until the longest text is down to one name.
    level = blocks.select("entry", "n_blocks", "idx", "name")
    finished = level.where("n_blocks = 1").select("entry", "n_blocks", "name")
    span, longest = 1, blocks.agg(F.max("n_blocks")).first()[0] or 1
    while span < longest:
        span *= 2
        odd = F.col("idx") % 2 == 1
        pairs = (level.where(F.col("n_blocks") > span // 2)
                 .groupBy("entry", "n_blocks", F.floor(F.col("idx") / 2).alias("half"))
                 .agg(F.max(F.when(~odd, F.col("name"))).alias("left"), F.max(F.when(odd, F.col("name"))).alias("right"))
                 .withColumnRenamed("half", "idx"))
        level = handed_over(_named(pairs, "left", "right"), f"pairs{span}")
        finished = finished.unionAll(level.where(F.col("n_blocks") <= span).select("entry", "n_blocks", "name"))

    entries = handed_over(finished.join(blocks.where("idx = 0").select("entry", "ids", "best", "longest", "digest"), "entry"), "entries")
    first = F.min(F.struct(-F.col("longest"), F.col("best").isNull(), F.col("best"), F.col("entry")))
    groups = entries.groupBy("n_blocks", "name").agg(first.alias("first"), F.sum(F.size("ids")).alias("group_size"))
    members = entries.join(groups, ["n_blocks", "name"]).select("entry", "first", "group_size", "digest", F.posexplode("ids").alias("at", "doc_id"))
    return members.select("doc_id", F.col("first.best").alias("keep_id"), F.col("group_size"),
                          ((F.col("entry") == F.col("first.entry")) & (F.col("at") == 0)).alias("kept"), F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose doc_id stays; rows that share a doc_id stay or go together."""
    stay = duplicate_groups(docs, block_bytes).where("kept").select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stays"]), "left_semi")
