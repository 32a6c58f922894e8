"""Temporal aggregation of phrase occurrences.

Input: a ``phrases`` frame with at least ``phrase_hash, phrase, year, decade,
frequency`` (one row per article and phrase).  ``phrase_hash`` and ``decade``
may be missing: rows are then grouped by phrase and year alone, the decade is
that of the year, and ``with_phrase_hash`` adds the hash to the result.

* ``yearly_totals``: total frequency per year.
* ``phrase_timelines``: per phrase and year, ``raw_count`` and
  ``normalized_frequency = raw_count / year total``.
* ``phrase_statistics``: per phrase, first/last year, total count, peak year
  (highest yearly count, earliest on ties), peak decade (highest decade count,
  smallest decade label on ties) and temporal entropy over the phrase's own
  decades (``-sum p ln p / ln n``, 0 when the phrase lives in one decade).

Plan notes:
* with ``phrase_hash``, every aggregate is partial (map-side) first, so a phrase
  that holds a third of all rows is reduced to one row per (task, year) before
  the shuffle;
* without it (phrases of texts: most are rare, and a phrase has at most one row
  an article) rows go once to their phrase's partition, as phrase, year and
  frequency; timelines, statistics and features all run on that partitioning.
  Phrases with ``phrase_head`` were dealt by it when they were made, and it is
  part of every key;
* yearly totals are sums of the timeline's counts, which are stored (with
  ``phrase_hash``), or of the rows out of an exchange that Spark reuses
  (without), so what is below runs once;
* yearly totals are joined with a broadcast: one row per distinct year and
  years are 4-digit by construction, so the table can never exceed 10,000 rows;
* statistics are computed from the timeline, which has at most one row per
  (phrase, year): it is hash-partitioned once by ``phrase_hash`` and the
  decade-level and phrase-level aggregates both run on that partitioning (no
  join, no window, one exchange).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import ids
from tempora.functions.timeparts import decade_key, decade_of_year
from tempora.session import shared_table

# A year column produced by the ingest is 4-digit, so this bounds the number
# of rows of the yearly totals table (the broadcast side).
MAX_DISTINCT_YEARS = 10_000
# Peak year as one long: count * 2^14 + (2^14 - 1 - year).  The maximum is
# the highest count and, among equal counts, the earliest year; a primitive
# max keeps the aggregate hash-based (a struct min would force a sort-based
# aggregate over the whole timeline).  Years are < 2^14 and counts < 2^49.
_YEAR_BITS = 14
_YEAR_MASK = (1 << _YEAR_BITS) - 1


def _pack_peak(count, year):
    return count.cast("bigint") * (1 << _YEAR_BITS) + (F.lit(_YEAR_MASK) - year.cast("bigint"))


def _unpack_year(packed):
    return (F.lit(_YEAR_MASK) - (packed.bitwiseAND(F.lit(_YEAR_MASK)))).cast("int")


def yearly_totals(phrases: DataFrame) -> DataFrame:
    return phrases.groupBy("year").agg(F.sum("frequency").cast("bigint").alias("total_frequency"))


def phrase_keys(frame: DataFrame) -> list[str]:
    return [c for c in ("phrase_hash", "phrase", "phrase_head") if c in frame.columns]


def with_phrase_hash(frame: DataFrame) -> DataFrame:
    """``frame`` with ``phrase_hash`` of its (cleaned) phrase in front, and without ``phrase_head``.

    The hash is never null; told so, a join by it doesn't make it once more for a filter."""
    frame = frame.drop("phrase_head")
    return frame.select(F.coalesce(ids.phrase_hash(F.col("phrase")), F.lit("")).alias("phrase_hash"), *frame.columns)


def dealt_phrases(phrases: DataFrame) -> DataFrame:
    """``phrases`` without ``phrase_hash`` with each phrase in one partition; those with ``phrase_head`` are so already."""
    return phrases if {"phrase_hash", "phrase_head"} & set(phrases.columns) else phrases.repartition("phrase")


def yearly_counts(phrases: DataFrame) -> DataFrame:
    """``[phrase_hash,] phrase, year, decade, raw_count``."""
    keys = phrase_keys(phrases)
    rows = dealt_phrases(phrases)
    decade = ["decade"] if "decade" in phrases.columns else []
    counts = rows.groupBy(*keys, "year", *decade).agg(F.sum("frequency").cast("bigint").alias("raw_count"))
    return counts.select(*keys, "year", F.col("decade") if decade else decade_of_year(F.col("year")).alias("decade"), "raw_count")


def phrase_timelines(phrases: DataFrame) -> DataFrame:
    counts = yearly_counts(phrases)
    if "phrase_hash" in counts.columns:
        # A row a phrase and year, read twice: what made the phrases runs once.
        counts = shared_table(counts, "counts")
        totals = yearly_totals(counts.withColumnRenamed("raw_count", "frequency"))
    else:
        # The counts' exchange, not the counts: they would be made twice.
        totals = yearly_totals(dealt_phrases(phrases))
    return (counts.join(F.broadcast(totals), "year")
            .select(*phrase_keys(counts), "year", "decade", "raw_count",
                    (F.col("raw_count").cast("double") / F.col("total_frequency")).alias("normalized_frequency")))


def by_phrase(timelines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Timelines with each phrase in one partition; those without ``phrase_hash`` come so from :func:`yearly_counts`."""
    if "phrase_hash" not in timelines.columns:
        return timelines.repartition(partitions, "phrase") if partitions else timelines
    return timelines.repartition(partitions, "phrase_hash") if partitions else timelines.repartition("phrase_hash")


def phrase_statistics_from_timelines(timelines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Statistics per phrase from a timeline frame (``[phrase_hash,] phrase, year,
    decade, raw_count``).

    Both levels are sums, minima and maxima of primitives (hash aggregates):
    the entropy of counts ``c`` with sum ``T`` over ``n`` decades is
    ``(ln T - sum(c ln c) / T) / ln n``, and the peak decade is packed like the
    peak year.
    """
    keys = phrase_keys(timelines)
    decades = by_phrase(timelines, partitions).groupBy(*keys, "decade").agg(*decade_sums())
    totals = decades.groupBy(*keys).agg(*(c.alias(name) for name, c in phrase_sums().items()))
    return totals.select(*keys, *statistics_columns())


def decade_sums() -> list[Column]:
    """Sums of a phrase's decade, out of its timeline rows."""
    return [F.sum("raw_count").alias("decade_count"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
            # earliest year among those with the highest count
            F.max(_pack_peak(F.col("raw_count"), F.col("year"))).alias("peak")]


def phrase_sums() -> dict[str, Column]:
    """Sums of a phrase, out of its decades' (:func:`decade_sums`), as aggregates (or window functions)."""
    count = F.col("decade_count").cast("double")
    return {"first_year": F.min("first_year"), "last_year": F.max("last_year"), "total_count": F.sum("decade_count"), "peak": F.max("peak"),
            "peak_decade": F.max(_pack_peak(F.col("decade_count"), decade_key(F.col("decade")))), "n_decades": F.count(F.lit(1)),
            "count_logs": F.sum(F.when(count > 0, count * F.ln(count)).otherwise(0.0))}


def statistics_columns() -> list[Column]:
    """The statistics of a phrase out of :func:`phrase_sums`."""
    total = F.col("total_count").cast("double")
    entropy = F.when(F.col("n_decades") <= 1, F.lit(0.0)).otherwise(
        (F.ln(total) - F.col("count_logs") / total) / F.ln(F.col("n_decades").cast("double")))
    return [F.col("first_year").cast("int").alias("first_year"),
            F.col("last_year").cast("int").alias("last_year"),
            _unpack_year(F.col("peak")).alias("peak_year"),
            F.concat(_unpack_year(F.col("peak_decade")).cast("string"), F.lit("s")).alias("peak_decade"),
            F.col("total_count").cast("bigint").alias("total_count"),
            entropy.alias("temporal_entropy")]


def phrase_statistics(phrases: DataFrame, partitions: int | None = None) -> DataFrame:
    return phrase_statistics_from_timelines(yearly_counts(phrases), partitions)


# ---------------------------------------------------------------------------
# Window forms of the peak rankings (offered as operators; the statistics above
# compute the same peaks without a window)
# ---------------------------------------------------------------------------
def ranked_years(timelines: DataFrame) -> DataFrame:
    """Row number of each (phrase, year) by raw_count desc, year asc."""
    window = Window.partitionBy("phrase_hash").orderBy(F.col("raw_count").desc(), F.col("year"))
    return timelines.select("phrase_hash", "phrase", "year", "raw_count",
                            F.row_number().over(window).alias("rank"))


def ranked_decades(timelines: DataFrame) -> DataFrame:
    """Row number of each (phrase, decade) by decade_count desc, decade asc."""
    counts = (timelines.groupBy("phrase_hash", "phrase", "decade")
              .agg(F.sum("raw_count").cast("bigint").alias("decade_count")))
    window = Window.partitionBy("phrase_hash").orderBy(F.col("decade_count").desc(), F.col("decade"))
    return counts.select("phrase_hash", "phrase", "decade", "decade_count",
                         F.row_number().over(window).alias("rank"))
