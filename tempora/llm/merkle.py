"""Merkle dataset manifest: a tree of hashes for each source, a tree over the sources, and proofs by a recursive climb.

A leaf is H (lower-case hex SHA-256) of a row's fields, each as ``-`` if null, else its number of UTF-8 bytes, ``:`` and its
value.  Leaves of a source are numbered by doc_id; runs of ``arity`` neighbours become H of their digests' hex texts, level by
level, until one is left, the source's subroot.  Subroots, by source, become the root in the same way.

*Building.*  Rows get their places by ranges (:func:`shared.numbered`), so a source with a third of all rows is spread like any
other.  Blocks of ``arity ** stride`` neighbours are hashed up ``stride`` levels in one group, so there is a shuffle for every
``stride`` levels, and each has that many times fewer rows than the one before.

*Stored rows.*  A node row has its id, the id of its parent (the node at the top of its block; null above the last level) and the
siblings on either side in each run on the way to that parent.  The subroots are the leaves of the tree over the sources.

*Climb.*  A recursive common table expression starts with all leaves and joins the parent's row in each step: it appends the
siblings to the proof and folds them with the hash at hand, the one of the text that is presented.  A climb ends at the root, after
as many steps as there are blocks on the way: with the defaults a source of 387 million rows takes three, and its number of rows
is that of the leaves in each.  Upper rows are few and asked for by many leaves; they are broadcast while all node rows are
counted to be at most ``MOST_BROADCAST``, beyond that Spark splits the skewed join.

Defined cases: null and empty fields differ (``-`` and ``0:``); a null source is a source of its own, before all others; a null
doc_id comes first in its source, and rows that share a doc_id are ordered by their leaves (equal rows are equal leaves, each
with its own place and proof); a source of one row is its own subroot, a table of one row its own root, with an empty proof;
an empty table gives an empty result and no root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import handed_over, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
STRIDE = 6
MOST_BROADCAST = 65_536
#: An id is a stride's number and the number of the first leaf below; the strides of the tree over the sources begin here.
_ABOVE = 32


def digest(binary: Column) -> Column:
    """H of the hex text of some digests, which are bytes one after the other."""
    return F.unhex(F.sha2(F.lower(F.hex(binary)), 256))


def leaf_digest(values: list[Column]) -> Column:
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256))


def _nothing() -> Column:
    return F.lit(bytearray())


def _level_above(level: Column, arity: int) -> Column:
    runs = F.sequence(F.lit(0), ((F.size(level) - 1) / arity).cast("int"))
    return F.transform(runs, lambda run: digest(F.concat(*(F.coalesce(F.get(level, run * arity + i), _nothing()) for i in range(arity)))))


def _siblings(level: Column, place: Column, arity: int) -> Column:
    """What stands in the run of ``place`` to its left and to its right."""
    at = place % arity
    left = [F.when(at >= d, F.get(level, place - d)).otherwise(_nothing()) for d in range(arity - 1, 0, -1)]
    right = [F.when(at + d < arity, F.coalesce(F.get(level, place + d), _nothing())).otherwise(_nothing()) for d in range(1, arity)]
    return F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def _whole_steps(size: Column, arity: int, stride: int) -> Column:
    """How many levels of a stride a level of ``size`` nodes still has above it."""
    return reduce(lambda a, b: a + b, [(size > arity ** k).cast("int") for k in range(stride)])


def _blocks(rows: DataFrame, carried: list[str], arity: int, stride: int) -> DataFrame:
    """``rows``: tree, size (nodes of the tree at this level), place, hash and carried columns.  One row a block: tree, size, block,
    members (in order), steps (levels up to its top) and the levels from its members (level0) to its top."""
    member = F.struct("place", "hash", *carried)
    block = rows.groupBy("tree", "size", F.floor(F.col("place") / arity ** stride).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    block = block.withColumn("steps", _whole_steps(F.col("size"), arity, stride)).withColumn("level0", F.col("members.hash"))
    for k in range(stride):
        above = F.when(F.col("steps") > k, _level_above(F.col(f"level{k}"), arity)).otherwise(F.array().cast("array<binary>"))
        block = block.withColumn(f"level{k + 1}", above)
    return block


def _members(block: DataFrame, carried: list[str], arity: int, stride: int) -> DataFrame:
    """One row a member: tree, size, block, place, hash, carried columns and path (siblings by level, up to the block's top)."""

    def row(member: Column, i: Column) -> Column:
        path = F.array(*(_siblings(F.col(f"level{k}"), F.floor(i / arity ** k).cast("int"), arity) for k in range(stride)))
        return F.struct(*(member[c].alias(c) for c in ("place", "hash", *carried)), F.slice(path, F.lit(1), F.col("steps")).alias("path"))

    return block.select("tree", "size", "block", F.inline(F.transform("members", row)))


@dataclass(frozen=True)
class Manifest:
    """Stored rows: ``leaves`` (doc_id, leaf, presented, parent, path), ``nodes`` (id, parent, path, subroot: set at subroots) and ``sources`` (source,
    size, subroot), and the root's hex text (None for an empty table)."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None


def _grown(rows: DataFrame, carried: list[str], first_stride: int, above: int | None, arity: int, stride: int, name: str) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Hash trees up to their tops: the rows of the lowest level, those of the strides above it, and the tops (tree, hash).

    A parent's id is its stride and the number of its first leaf; that of a top is ``above`` and its tree (null without ``above``).
    """
    lowest, strides, tops, at = None, [], [], 0
    while True:
        width = arity ** (stride * (at + 1))
        block = handed_over(_blocks(rows, carried if at == 0 else ["id"], arity, stride), f"{name}{at}")
        is_top = F.col("size") <= arity ** stride
        top_id = F.lit(None).cast("long") if above is None else F.col("tree") + F.lit(above << 48)
        parent = F.when(is_top, top_id).otherwise(F.col("tree") + F.col("block") * width + F.lit((first_stride + at + 1) << 48))
        found = _members(block, carried if at == 0 else ["id"], arity, stride).withColumn("parent", parent)
        lowest = found if lowest is None else lowest
        strides += [found] if at else []
        last = F.coalesce(*(F.get(f"level{k}", F.lit(0)) for k in range(stride, -1, -1)))
        up = block.select("tree", "size", "block", last.alias("hash"))
        tops.append(up.where(is_top).select("tree", "hash"))
        rows = up.where(~is_top).select("tree", F.ceil(F.col("size") / arity ** stride).alias("size"), F.col("block").alias("place"), "hash",
                                        (F.col("tree") + F.col("block") * width + F.lit((first_stride + at + 1) << 48)).alias("id"))
        if block.where(~is_top).isEmpty():
            return lowest, strides, reduce(DataFrame.unionAll, tops)
        at += 1


def built(docs: DataFrame, presented: Column | None = None, arity: int = ARITY, stride: int = STRIDE) -> Manifest:
    """The manifest of ``docs``.  ``presented``: the text that is to be checked against it (by default the one of the row)."""
    base = docs.select(*FIELDS, (F.col("text") if presented is None else presented).alias("_presented"))
    leaf = leaf_digest([F.col(c) for c in FIELDS])
    now = F.when(F.col("_presented").eqNullSafe(F.col("text")), F.col("leaf")).otherwise(leaf_digest([F.col(c) for c in FIELDS[:-1]] + [F.col("_presented")]))
    rows = base.withColumn("leaf", leaf).withColumn("presented", now).select("doc_id", "source", "leaf", "presented", F.monotonically_increasing_id().alias("row"))
    placed = handed_over(numbered(rows, "leaves", "source", "doc_id", "leaf", "row"), "leaves")
    sources = handed_over(placed.groupBy("source").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size")), "sources")
    of = sources.select(F.col("source").alias("of"), "first", "size")
    of = F.broadcast(of) if of.count() <= MOST_BROADCAST else of
    leaves = placed.join(of, placed["source"].eqNullSafe(of["of"])).select(
        F.col("first").alias("tree"), "size", (F.col("number") - F.col("first")).alias("place"), F.col("leaf").alias("hash"), "doc_id", "presented")
    lowest, strides, tops = _grown(leaves, ["doc_id", "presented"], 0, _ABOVE, arity, stride, "source")

    subroots = handed_over(sources.join(tops, sources["first"] == tops["tree"]).select("source", "size", "first", F.col("hash").alias("subroot")), "subroots")
    n = subroots.count()
    top = numbered(subroots.select("first", "subroot"), "subroots", "first").select(
        F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("size"), F.col("number").alias("place"), F.col("subroot").alias("hash"),
        (F.col("first") + F.lit(_ABOVE << 48)).alias("id"))
    over, more, last = _grown(top, ["id"], _ABOVE, None, arity, stride, "over")
    kept = ("id", "parent", "path")
    nodes = [m.select(*kept, F.lit(None).cast("binary").alias("subroot")) for m in (*strides, *more)] + [over.select(*kept, F.col("hash").alias("subroot"))]
    root = last.select(F.lower(F.hex("hash"))).first()
    return Manifest(lowest.select("doc_id", F.col("hash").alias("leaf"), "presented", "parent", "path"), handed_over(reduce(DataFrame.unionAll, nodes), "nodes"),
                    subroots.select("source", "size", F.lower(F.hex("subroot")).alias("subroot")), root[0] if root else None)


_CLIMB = """
    WITH RECURSIVE climb (doc_id, leaf, at, folded, proof, subroot) AS (
        SELECT doc_id, leaf, parent, {folded}, {siblings}, CAST(NULL AS BINARY) FROM {leaves}
        UNION ALL
        SELECT {hint} climb.doc_id, climb.leaf, parent, {climbing}, concat(climb.proof, {siblings}), coalesce(climb.subroot, node.subroot)
        FROM climb JOIN {nodes} AS node ON node.id = climb.at)
    SELECT doc_id, leaf, folded, proof, subroot FROM climb WHERE at IS NULL LIMIT ALL
"""
_FOLD = "aggregate(path, {start}, (h, step) -> unhex(sha2(lower(hex(concat(step.left, h, step.right))), 256)))"


def proofs(manifest: Manifest) -> DataFrame:
    """One row a leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (hex texts)."""
    spark, few = manifest.nodes.sparkSession, manifest.nodes.count() <= MOST_BROADCAST
    views = {"leaves": f"leaves_{uuid.uuid4().hex}", "nodes": f"nodes_{uuid.uuid4().hex}"}
    manifest.leaves.createOrReplaceTempView(views["leaves"])
    manifest.nodes.createOrReplaceTempView(views["nodes"])
    climb = spark.sql(_CLIMB.format(**views, hint="/*+ BROADCAST(node) */" if few else "", folded=_FOLD.format(start="presented"), climbing=_FOLD.format(start="climb.folded"),
                                    siblings="aggregate(path, X'', (all, step) -> concat(all, step.left, step.right))"))
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "folded", "proof")}
    found = climb.select("doc_id", text["leaf"].alias("leaf"), text["subroot"].alias("subroot"), F.lit(manifest.root).alias("root"),
                         F.sha2(text["proof"], 256).alias("proof_sha256"), text["folded"].alias("folded_root"))
    found = handed_over(found.withColumn("verified", F.col("folded_root") == F.col("root")), "proofs")
    for view in views.values():
        spark.catalog.dropTempView(view)
    return found


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without line feeds in rows whose doc_id has an even CRC-32 (of its decimal text); other texts as they are."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
