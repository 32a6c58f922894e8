"""Probability distributions over decades.

Two shapes are supported:

* long form — one row per (key..., decade, value): ``normalize_over_key``
  uses a window sum over the key (the caller's partitioning is reused);
* array form — ``array<struct<decade, probability>>`` in decade order, for
  per-row distributions: ``normalize_array``, ``softmax_array``,
  ``top_of_array``.

Semantics: negative values are clamped to 0; values are divided by their sum;
an all-zero distribution becomes uniform; an empty one stays empty.  The top
decade is the first maximum in decade order (null and 0.0 when empty).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_over_key(frame: DataFrame, keys: list[str], value_col: str, out_col: str) -> DataFrame:
    if not keys:
        raise ValueError("normalize_over_key needs at least one key: without one all rows would be one group")
    window = Window.partitionBy(*keys)
    clamped = F.greatest(F.col(value_col), F.lit(0.0))
    total = F.sum(clamped).over(window)
    count = F.count(F.lit(1)).over(window)
    result = (frame.withColumn("_total", total).withColumn("_n", count)
              .withColumn(out_col, F.when(F.col("_total") > 0, clamped / F.col("_total"))
                          .otherwise(F.lit(1.0) / F.col("_n"))))
    return result.drop("_n", "_total")


def normalize_array(dist: Column) -> Column:
    """Normalize an ``array<struct<decade, probability>>`` distribution."""
    clamped = F.transform(dist, lambda e: F.struct(e["decade"].alias("decade"),
                                                   F.greatest(e["probability"], F.lit(0.0)).alias("probability")))
    total = F.aggregate(clamped, F.lit(0.0), lambda acc, e: acc + e["probability"])
    n = F.size(dist)
    return F.when(total > 0, F.transform(clamped, lambda e: F.struct(
        e["decade"].alias("decade"), (e["probability"] / total).alias("probability")))).otherwise(
        F.transform(clamped, lambda e: F.struct(e["decade"].alias("decade"),
                                                (F.lit(1.0) / n).alias("probability"))))


def softmax_array(scores: Column) -> Column:
    """Max-shifted exponentials, normalized (empty stays empty)."""
    top = F.array_max(F.transform(scores, lambda e: e["probability"]))
    shifted = F.transform(scores, lambda e: F.struct(e["decade"].alias("decade"),
                                                     F.exp(e["probability"] - top).alias("probability")))
    return normalize_array(shifted)


def top_of_array(dist: Column) -> Column:
    """struct<decade, probability> of the first maximum; (null, 0.0) when empty."""
    empty = F.struct(F.lit(None).cast("string").alias("decade"), F.lit(0.0).alias("probability"))
    first = F.element_at(dist, 1)
    best = F.aggregate(dist, first, lambda acc, e: F.when(e["probability"] > acc["probability"], e).otherwise(acc))
    return F.when(F.size(dist) > 0, best).otherwise(empty)


def round_array(dist: Column, places: int = 6) -> Column:
    return F.transform(dist, lambda e: F.struct(e["decade"].alias("decade"),
                                                F.round(e["probability"], places).alias("probability")))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 when the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
