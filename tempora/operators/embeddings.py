"""Embedding manifest and embedding generation.

* ``embedding_manifest``: one row per distinct phrase with a deterministic
  ``embedding_id`` (hash of model name and phrase hash) and status
  ``not_generated``.
* ``generate_embeddings``: vectors for the manifest phrases.  The encoder is supplied by the caller as a function
  ``list[str] -> list[list[float]]`` factory; it is created once per task
  inside ``mapInPandas`` and fed Arrow batches.  The default encoder is a
  hashed character-trigram vector in Spark expressions, so nothing has to be
  downloaded and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import ids

# Fixed value: the manifest status before vectors exist.
NOT_GENERATED = "not_generated"
GENERATED = "generated"


def embedding_manifest(statistics: DataFrame, model_name: str = "pending") -> DataFrame:
    """Manifest rows from the phrase statistics (``phrase_hash, phrase``)."""
    distinct = statistics.groupBy("phrase_hash").agg(F.min("phrase").alias("phrase"))
    return distinct.select(
        "phrase_hash", "phrase", F.lit(model_name).alias("model_name"),
        ids.embedding_id(F.col("phrase_hash"), model_name).alias("embedding_id"),
        F.lit(NOT_GENERATED).alias("embedding_status"))


def _bucket_counts(dimension: int) -> Column:
    """The default encoder's counts for the column ``phrase``: character trigrams of the text (with a blank on both
    sides) by the first 32 bits of their MD5, modulo ``dimension``."""
    padded = F.concat(F.lit(" "), F.coalesce("phrase", F.lit("")), F.lit(" "))
    last = F.length(padded) - 2
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.call_function("substring", padded, i, F.lit(3)))
    buckets = F.transform(F.when(last >= 1, grams).otherwise(F.array().cast("array<string>")),
                          lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint") % dimension).cast("int"))
    # One bucket at a time, added into the vector: a phrase has at most some ninety trigrams.
    return F.aggregate(buckets, F.array_repeat(F.lit(0.0), dimension),
                       lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)))


def generate_embeddings(manifest: DataFrame, model_name: str,
                        encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
                        max_rows: int | None = None, dimension: int = 64) -> DataFrame:
    """Vectors for all manifest phrases (``max_rows``: only the first, in the
    order of their hash), status ``generated``.  Without an encoder of the
    caller's own the default one runs as Spark expressions."""
    selected = manifest.select("phrase_hash", "phrase")
    if max_rows is not None:
        selected = selected.orderBy("phrase_hash").limit(max_rows)
    if encoder_factory is None:
        counted = selected.withColumn("_counts", _bucket_counts(dimension))
        norm = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda acc, v: acc + v * v))
        scaled = counted.withColumn("_norm", norm)
        encoded = scaled.select("phrase_hash", "phrase", F.transform("_counts", lambda v: F.when(F.col("_norm") > 0, v / F.col("_norm")).otherwise(v).cast("float")).alias("embedding"))
    else:
        def encode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = encoder_factory()
            for batch in batches:
                vectors = encode(batch["phrase"].tolist())
                yield batch.assign(embedding=[v.astype(np.float32).tolist() for v in vectors])

        encoded = selected.mapInPandas(encode_batches, "phrase_hash string, phrase string, embedding array<float>")
    return encoded.select(
        "phrase_hash", "phrase", F.lit(model_name).alias("model_name"),
        ids.embedding_id(F.col("phrase_hash"), model_name).alias("embedding_id"),
        F.lit(GENERATED).alias("embedding_status"), "embedding")
