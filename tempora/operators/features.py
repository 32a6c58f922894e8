"""Per-decade features and the training set.

``features``: one row per (phrase, decade) with the phrase statistics, the
decade score (sum of the yearly normalized frequencies in that decade), the
decade raw count and the target probability (decade score / the phrase's total
score, 0 when the total is 0).  Only phrases whose ``total_count`` reaches
``min_count`` are kept.

``training_set``: one row per phrase with a ``features`` struct and a
``target`` map decade -> probability in decade order.

Plan: the timeline is hash-partitioned once by phrase; decade scores and the
per-phrase score total (a window over the same key) reuse that partitioning.
Statistics that come from the same timeline are windows too, so the timeline
is read once and nothing is joined; given ones are joined.  A phrase contributes at most
one row per decade, so no key can be hot after the timeline aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.timeparts import decade_key
from tempora.operators.timelines import by_phrase, decade_sums, phrase_keys, phrase_sums, statistics_columns

# Decades are labels of 4-digit years.
MAX_DECADES = 1000
STAT_COLUMNS = ["first_year", "last_year", "peak_year", "peak_decade", "total_count", "temporal_entropy"]


def decade_scores(timelines: DataFrame) -> DataFrame:
    """(phrase_hash, phrase, decade, decade_score, decade_raw_count, target_probability)."""
    keys = phrase_keys(timelines)
    scores = (timelines.groupBy(*keys, "decade")
              .agg(F.sum("normalized_frequency").alias("decade_score"),
                   F.sum("raw_count").cast("bigint").alias("decade_raw_count")))
    total = F.sum("decade_score").over(Window.partitionBy(keys[0]))
    return scores.withColumn(
        "target_probability",
        F.when(total == 0, F.lit(0.0)).otherwise(F.col("decade_score") / total))


def build_features(timelines: DataFrame, statistics: DataFrame | None = None, min_count: int = 2,
                   partitions: int | None = None) -> DataFrame:
    """Feature rows from timelines (and statistics, computed here when absent)."""
    rows, keys = by_phrase(timelines, partitions), phrase_keys(timelines)
    if statistics is None:
        return _features_with_statistics(rows, keys, min_count)
    stats = statistics.where(F.col("total_count") >= min_count)
    scores = decade_scores(rows)
    return (stats.join(scores.drop(*keys[1:]), keys[0])
            .select(*keys, *STAT_COLUMNS, "decade", "decade_score",
                    "decade_raw_count", "target_probability"))


def _features_with_statistics(rows: DataFrame, keys: list[str], min_count: int) -> DataFrame:
    """Feature rows and the statistics from one pass: one aggregate by phrase and decade, and windows over a phrase's decades."""
    if "phrase_hash" in keys:
        rows = rows.where("phrase_hash IS NOT NULL")  # as in the join
    decades = rows.groupBy(*keys, "decade").agg(
        F.sum("normalized_frequency").alias("decade_score"), F.sum("raw_count").cast("bigint").alias("decade_raw_count"), *decade_sums())
    phrase = Window.partitionBy(*keys)
    sums = {**phrase_sums(), "_score": F.sum("decade_score")}
    summed = decades.select(*keys, "decade", "decade_score", "decade_raw_count", *(c.over(phrase).alias(name) for name, c in sums.items()))
    probability = F.when(F.col("_score") == 0, F.lit(0.0)).otherwise(F.col("decade_score") / F.col("_score"))
    return summed.where(F.col("total_count") >= min_count).select(
        *keys, *statistics_columns(), "decade", "decade_score", "decade_raw_count", probability.alias("target_probability"))


def training_set(features: DataFrame) -> DataFrame:
    """One row per phrase: ``phrase, phrase_hash, features struct, target map``.

    The decades of the features (at most ``MAX_DECADES``, read once) give one
    sum each, so the aggregate holds primitives only; the statistics of a
    phrase are part of its key.
    """
    found = (features.select("decade").distinct().orderBy(decade_key(F.col("decade")), "decade")
             .limit(MAX_DECADES + 1).collect())
    if len(found) > MAX_DECADES:
        raise ValueError(f"features cannot have more than {MAX_DECADES} decades")
    decades = [row["decade"] for row in found]
    grouped = features.groupBy(*phrase_keys(features), *STAT_COLUMNS).agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.sum(F.when(F.col("decade") == d, F.col("target_probability"))).alias(f"_p{i}") for i, d in enumerate(decades)))
    entries = F.array(*(F.struct(F.lit(d).alias("decade"), F.col(f"_p{i}").alias("p")) for i, d in enumerate(decades)))
    entries = entries.cast("array<struct<decade:string,p:double>>")
    target = F.map_from_entries(F.filter(entries, lambda e: e["p"].isNotNull()))
    return grouped.select(
        *reversed(phrase_keys(features)),
        F.struct(F.col("first_year").cast("int").alias("first_year"),
                 F.col("last_year").cast("int").alias("last_year"),
                 F.col("peak_year").cast("int").alias("peak_year"),
                 F.col("peak_decade").alias("peak_decade"),
                 F.col("total_count").cast("bigint").alias("total_count"),
                 F.col("temporal_entropy").cast("double").alias("temporal_entropy")).alias("features"),
        target.alias("target"))
