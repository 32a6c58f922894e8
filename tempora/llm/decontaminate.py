"""Benchmark decontamination by a distributed positional inverted index.

The index has one posting (term, doc, pos) for each place of the corpus where a term of the test items stands, stored as
a Parquet table.  Every window of test words (13 consecutive words of an item, or a shorter item as a whole) is looked
up from its rarest terms, by their number of postings: the lists of its three rarest terms, adjusted by the terms'
offsets, are intersected, which leaves alignments (item, doc, shift: the item's first word would stand there; below 0 in a
document that begins inside the item).  The
lists of all terms of the aligned items are then intersected with these alignments; runs of consecutive item words
that all stand in place and are as long as a window are exact phrase matches.  :func:`near_matches` reads the same index for
proximity: the documents in which an item's three rarest terms (of those that occur at all, ties by the word) stand close together
in any order; items with fewer such terms have no proximity match.

Everything is DataFrame functions.  Postings come from one pass over the corpus; common words of long lists are read
but only joined for documents that already have an alignment.  The terms and items of the test are broadcast
while they are few (``MOST_BROADCAST`` rows); beyond that they are joined by a shuffle, as are alignments.

Defined cases: a null text has no words; rows that share a doc_id and text are one document with one result for each
row, rows that share only the doc_id are documents of their own; a null doc_id or item_id is an id like any other
(a null item_id is left out of the digest of ids); repeated items count once per id; empty tables give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import handed_over

WINDOW_WORDS = 13
RAREST = 3
MOST_BROADCAST = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOC = ["doc_id", "doc_hash"]


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, split at ASCII characters that are neither digits nor letters."""
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(pieces, lambda w: w != "")


def _small(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= MOST_BROADCAST else frame


def _same_doc(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["doc_hash"] == right["doc_hash"])


def item_words(items: DataFrame) -> DataFrame:
    """item (a number), item_id, length, at, word: the words of each distinct item."""
    named = items.select("item_id", words(F.col("text")).alias("words")).distinct().where(F.size("words") > 0)
    keyed = named.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "words"))
    return keyed.select("item", "item_id", F.size("words").alias("length"), F.posexplode("words").alias("at", "word"))


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), words(F.col("text")).alias("words"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The index: term (a number of ``terms``: word, term), doc_id, doc_hash, pos; rows that repeat a document repeat its postings."""
    places = with_hash(docs).select(*_DOC, F.posexplode("words").alias("pos", "word"))
    return places.join(_small(terms, n_terms), "word").select("term", *_DOC, "pos")


def _rarest(test: DataFrame, window_words: int) -> DataFrame:
    """item, and for some window the terms t1, t2, t3 (rarest first) at a1, a2, a3: enough of these that every window of the
    item has all three of its rarest terms there.  ``test``: item, length, at, term, n (its postings)."""
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - window_words + 1),
                                 F.greatest(F.lit(0), F.least(F.col("at"), F.col("length") - window_words)))).alias("start")
    inside = test.select("item", "at", "term", "n", start)
    order = Window.partitionBy("item", "start").orderBy("n", "term", "at")
    ranked = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= RAREST)
    found = ranked.groupBy("item", "start").agg(*(F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c[0]}{k}") for k in range(1, RAREST + 1) for c in ("term", "at")))
    return found.drop("start").distinct()


def alignments(index: DataFrame, test: DataFrame, n_test: int, window_words: int) -> DataFrame:
    """item, doc_id, doc_hash, shift where the rarest terms of some window of the item stand in their order and distances."""
    wanted = handed_over(_rarest(test, window_words), "rarest_terms")
    lists = [index.join(_small(wanted.select(F.col(f"t{k}").alias("term")).distinct(), n_test), "term", "left_semi") for k in range(1, RAREST + 1)]
    first = lists[0].withColumnRenamed("term", "t1")
    found = first.join(_small(wanted, n_test), "t1").select("item", *_DOC, (F.col("pos") - F.col("a1")).alias("shift"),
                                                            *(f"{c}{k}" for k in range(2, RAREST + 1) for c in "ta"))
    for k in range(2, RAREST + 1):
        # A window of fewer words has no k-th term: nothing to intersect.
        here, there = found, lists[k - 1].select(F.col("term").alias("_t"), F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h"), F.col("pos").alias("_p"))
        has = here[f"t{k}"].isNotNull()
        met = here.where(has).join(there, (here[f"t{k}"] == there["_t"]) & here["doc_id"].eqNullSafe(there["_d"]) & (here["doc_hash"] == there["_h"])
                                   & (here["shift"] + here[f"a{k}"] == there["_p"]), "left_semi")
        found = met.unionAll(here.where(~has))
    return found.select("item", *_DOC, "shift").distinct()


@dataclass(frozen=True)
class Index:
    """The words of the test items, the postings of their terms, and the length of each term's list (term, n)."""

    test: DataFrame
    postings: DataFrame
    lengths: DataFrame
    n_test: int
    n_terms: int


def indexed(docs: DataFrame, items: DataFrame) -> Index:
    test = handed_over(item_words(items).withColumn("term", F.xxhash64("word")), "item_words")
    terms = handed_over(test.select("word", "term").distinct(), "terms")
    n_test, n_terms = test.count(), terms.count()
    index = handed_over(postings(docs, terms, n_terms), "postings")
    lengths = handed_over(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "list_lengths")
    return Index(test, index, lengths, n_test, n_terms)


def hits(at: Index, window_words: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, doc_hash, item_id, pos: every document word inside an occurrence of a window of the item."""
    index, test, n_test = at.postings, at.test, at.n_test
    # Terms without a posting can't align: their windows go here.
    counted = handed_over(test.join(_small(at.lengths, at.n_terms), "term", "left").fillna(0, ["n"]), "counted_terms")
    found = handed_over(alignments(index, counted, n_test, window_words), "alignments")
    there = found.select(*_DOC).distinct()
    near = index.join(_small(there, there.count()), index["doc_id"].eqNullSafe(there["doc_id"]) & (index["doc_hash"] == there["doc_hash"]), "left_semi")
    asked = found.join(_small(counted.select("item", "length", "at", "term"), n_test), "item").withColumn("pos", F.col("shift") + F.col("at"))
    near = near.select(F.col("term").alias("_t"), F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h"), F.col("pos").alias("_p")).distinct()
    met = asked.join(near, (asked["term"] == near["_t"]) & asked["doc_id"].eqNullSafe(near["_d"]) & (asked["doc_hash"] == near["_h"]) & (asked["pos"] == near["_p"]), "left_semi")
    # Runs of consecutive item words that stand in place: a run's words less their rank are one number.
    line = Window.partitionBy("item", *_DOC, "shift")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(line.orderBy("at")))
    whole = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item", *_DOC, "shift", "run")))
    names = test.select("item", "item_id").distinct()
    kept = whole.where(F.col("n") >= F.least(F.col("length"), F.lit(window_words)))
    return kept.join(_small(names, n_test), "item").select(*_DOC, "item_id", "pos")


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, span: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least one word and a
    twentieth of all words are hit); with ``span`` also n_near, the items that have a proximity match within so many words."""
    index = indexed(docs, items)
    found = handed_over(hits(index, window_words), "hits")
    by_doc = (found.select(*_DOC, "pos").distinct().groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n_hit")))
    by_item = (found.select(*_DOC, "item_id").distinct().groupBy(*_DOC)
               .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids")))
    a, b = by_doc, by_item.select(F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h"), "n_items", "ids")
    marks = a.join(b, a["doc_id"].eqNullSafe(b["_d"]) & (a["doc_hash"] == b["_h"])).select(F.col("doc_id").alias("_doc"), F.col("doc_hash").alias("_hash"), "n_hit", "n_items", "ids")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    result = sizes.join(_small(marks, marks.count()), sizes["doc_id"].eqNullSafe(marks["_doc"]) & (sizes["doc_hash"] == marks["_hash"]), "left")
    n_hit, more = F.coalesce("n_hit", F.lit(0).cast("long")), []
    if span is not None:
        near = near_matches(index, span).select(*_DOC, "item_id").distinct().groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n_near"))
        near = handed_over(near.select(F.col("doc_id").alias("_near_doc"), F.col("doc_hash").alias("_near_hash"), "n_near"), "near")
        result = result.join(_small(near, near.count()), result["doc_id"].eqNullSafe(near["_near_doc"]) & (result["doc_hash"] == near["_near_hash"]), "left")
        more = [F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")]
    return result.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                         F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
                         ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), *more)


def near_matches(at: Index, span: int = 25) -> DataFrame:
    """item_id, doc_id, doc_hash, pos: places of an item's rarest term that has its two next rarest terms (other ones) at most
    ``span`` words away, in any order."""
    counted = at.test.select("item", "item_id", "term", "word").distinct().join(_small(at.lengths, at.n_terms), "term")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "word"))
    wanted = handed_over(counted.withColumn("rank", rank).where(F.col("rank") <= RAREST).select("item", "item_id", "term", "rank"), "near_terms")
    # One pass over the index for the lists of all ranks.
    lists = handed_over(at.postings.join(_small(wanted, at.n_test), "term").drop("term").distinct(), "near_lists")
    first = lists.where("rank = 1").drop("rank")
    for k in range(2, RAREST + 1):
        # Places are met by cells of span words, so that the join has equal keys; a place looks into its own and both next cells.
        other = lists.where(F.col("rank") == k).select(F.col("item").alias("_i"), F.col("doc_id").alias("_d"), F.col("doc_hash").alias("_h"),
                                                       F.col("pos").alias("_p"), F.floor(F.col("pos") / span).alias("_cell"))
        cells = first.withColumn("cell", F.explode(F.array(*(F.floor(F.col("pos") / span) + step for step in (-1, 0, 1)))))
        met = cells.join(other, (cells["item"] == other["_i"]) & cells["doc_id"].eqNullSafe(other["_d"]) & (cells["doc_hash"] == other["_h"]) & (cells["cell"] == other["_cell"])
                         & (F.abs(cells["pos"] - other["_p"]) <= span), "left_semi")
        first = met.drop("cell").distinct()
    return first.select("item_id", *_DOC, "pos")


def without_contaminated(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; rows that share a doc_id with a contaminated one go with it."""
    bad = contamination(docs, items, window_words).where("contaminated").select(F.col("doc_id").alias("goes")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["goes"]), "left_anti")
